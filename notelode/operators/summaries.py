"""Extractive summaries: the sentences of a text ranked on the graph of what they share.

The graph joins each two sentences by the cosine of their weighted words. It is never laid out: a step of the power iteration
goes from sentences to words and back, so time and memory grow with the words of a text and not with the pairs of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from notelode.plans.catalog import query
from notelode.plans.store import table

#: A sentence ends at a line's end, at a full-width mark, or at a mark that white space follows.
ENDS = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+|\n")
#: Words, and single characters of scripts without spaces.
TERMS = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
DAMPING, ROUNDS = 0.85, 30


def sentences_of(text: str | None) -> list[str]:
    return [s for s in map(str.strip, ENDS.split(text or "")) if s]


def sentence_ranks(sentences: list[str]) -> np.ndarray:
    """The rank of each sentence, 1 on average, to six places."""
    n, known = len(sentences), {}
    cells = [(k, known.setdefault(w, len(known))) for k, s in enumerate(sentences) for w in TERMS.findall(s.lower())]
    if not cells:
        return np.ones(n)
    pairs, tf = np.unique(np.array(cells, dtype=np.int64), axis=0, return_counts=True)
    row, col = pairs[:, 0], pairs[:, 1]
    weight = tf * np.log1p(n / np.bincount(col))[col]
    weight /= np.sqrt(np.bincount(row, weight * weight, n))[row]
    own = np.bincount(row, weight * weight, n)

    def step(v: np.ndarray) -> np.ndarray:
        """The sums of v over each sentence's neighbours, by their cosines; a sentence is no neighbour of itself."""
        return np.maximum(np.bincount(row, weight * np.bincount(col, weight * v[row])[col], n) - own * v, 0.0)

    degree = step(np.ones(n))
    alone = degree < 1e-9
    share = np.where(alone, 0.0, 1 / np.where(alone, 1.0, degree))
    rank = np.ones(n)
    for _ in range(ROUNDS):
        rank = (1 - DAMPING) + DAMPING * (step(rank * share) + rank[alone].sum() / n)
    return np.round(rank, 6)


def summary_of(sentences: list[str], ratio: float) -> list[str]:
    """The best of the sentences, that share of them and one at least, in their order, each once; of equal ones the first."""
    best = np.lexsort((np.arange(len(sentences)), -sentence_ranks(sentences)))[: max(1, int(len(sentences) * ratio))]
    return list(dict.fromkeys(sentences[k] for k in sorted(best)))


def summarised(docs: DataFrame, ratio: float = 0.6) -> DataFrame:
    """doc_id, sentences, kept (numbers), summary, from docs (doc_id, text): whole texts, one at a time within its row.

    A text without a sentence, a null one too, has an empty summary. Repeated rows give repeated rows; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                s = sentences_of(text)
                kept = summary_of(s, ratio) if s else []
                rows.append((doc_id, len(s), len(kept), " ".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "sentences", "kept", "summary"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sentences long, kept long, summary string")


@query()
def ranked_summaries(spark, sf_dir) -> DataFrame:
    """Six of ten sentences of every document, by their rank on the graph of sentences."""
    return summarised(table(spark, sf_dir, "documents"))
