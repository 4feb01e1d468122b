"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded texts.

Folding: lower case, marks off, homoglyphs and digit substitutions to the letters that they stand for (both sides are
folded alike, so i, l, 1, ! are one letter). A match counts if no letter or digit stands beside it (a stem may go on) and no exception phrase
covers it. The matched weights' sum over the number of words is the text's density; a logistic curve makes it a score.

The lexicon is learned from labelled training documents: folded words, and stems (beginnings of words, written ``stem*``),
that many toxic documents hold and few others; of stems that begin alike the shortest is kept.
Support is counted over different least word hashes, so a group of near copies counts about once. Candidates must be in
``min_share`` of the toxic training documents, so there are at most (stems of a document / min_share) of them: a
bound that does not grow with the data, and all of them that tell are kept. Words are counted as they are matched, by the
same folding. The curve is fitted to a histogram of
densities. Lexicon and curve are fitted on at most about ``train_rows`` labelled documents, chosen by hash; these ids are
the only table that is broadcast. Every document is scored.

Null and empty texts have density 0 and the score of it. Equal texts get equal scores. Without training documents of both
kinds the lexicon is empty and all scores are the share of toxic labels (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import WORD, in_parts, stored, table, workers_find_package

MIN_SHARE = 0.01
MIN_SUPPORT = 3
MIN_RATIO = 3.0  # natural log of toxic over clean document frequency
#: Parts in which the training documents are counted.
TRAIN_PARTS = 64
#: Lengths of stems.
STEMS = (4, 10)
TRAIN_ROWS = 50_000
BINS = 512
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "taking out the trash", "pond scum", "worthless check")
#: Homoglyphs and digit substitutions, and the letters that they stand for.
FROM = "013457!|@$8l" + "абвеёкмнорстухіїјѕһԁԛԝɡ" + "αβεικνορτυχ" + "ıłø"
TO = "oieastiiasbi" + "abbeekmhopctyxiijshdqwg" + "abeikvoptux" + "iio"
_FOLD = {ord(a): b for a, b in zip(FROM, TO, strict=True)}
_TAIL = re.compile(r"[!|@$]+(?![^\W_])|(?<![^\W_])[!|]+")
_MARKED = re.compile(r"[À-ɏ̀-ͯḀ-ỿ＀-～]")


def fold(text: str) -> str:
    """The folded text; symbols that end a word are white space, not letters."""
    if not text.isascii():
        text = "".join([c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)]) if _MARKED.search(text) else text
    return _TAIL.sub(" ", text.lower()).translate(_FOLD)


def split_folded(folded: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded)


class Matcher:
    """Lexicon and exception phrases in one automaton; entries and phrases are folded here."""

    def __init__(self, lexicon: Iterable[tuple[str, float]], exceptions: Iterable[str]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        entries: dict[str, tuple[float, bool]] = {}
        for word, weight in lexicon:
            entries[" ".join(split_folded(fold(word.rstrip("*"))))] = (weight, word.endswith("*"))
        for phrase in exceptions:
            entries[" ".join(split_folded(fold(phrase)))] = (0.0, False)
        for x, (weight, stem) in entries.items():
            if x:
                self.find.add_word(x, (len(x), weight, stem))
        self.empty = not len(self.find)
        if not self.empty:
            self.find.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """start, end, weight of each match that counts."""
        if self.empty:
            return []
        found = []
        for last, (n, weight, stem) in self.find.iter(folded):
            a, b = last + 1 - n, last + 1
            if (a == 0 or not folded[a - 1].isalnum()) and (stem or b == len(folded) or not folded[b].isalnum()):
                found.append((a, b, weight))
        free = [(a, b) for a, b, w in found if w == 0.0]
        return [(a, b, w) for a, b, w in found if w and not any(x <= a and b <= y for x, y in free)]


def density(matcher: Matcher, text: str | None) -> tuple[float, int]:
    """Matched weight for each word, and the number of matches."""
    if not text:
        return 0.0, 0
    hits = matcher.hits(fold(text))
    return (sum(w for _, _, w in hits) / len(re.findall(WORD, text)), len(hits)) if hits else (0.0, 0)


def folded_words(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and w: the different folded words of each text."""
    workers_find_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            yield b[kept].assign(w=[sorted(set(split_folded(fold(x or "")))) for x in b["text"]])

    return docs.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), "w array<string>"]))


def with_stems(words: str) -> Column:
    """The different words of three letters or more in a column of words, and their stems as ``stem*``."""
    low, high = STEMS
    stems = lambda w: F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.char_length(w)))), lambda k: F.concat(F.substring(w, 1, k), F.lit("*")))
    long = F.filter(words, lambda w: F.char_length(w) >= low)
    return F.array_union(F.filter(words, lambda w: F.char_length(w) >= 3), F.flatten(F.transform(long, stems)))


def learn_lexicon(train: DataFrame, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> list[tuple[str, float]]:
    """Words, stems and weights from train (w: different folded words, toxic); the weight is the smoothed log ratio of
    document frequencies. Of stems that begin alike the shortest is kept."""
    n_toxic, n_clean = (train.where(f"toxic = {k}").count() for k in (1, 0))
    if not n_toxic or not n_clean:
        return []
    near = F.array_min(F.transform("w", lambda x: F.xxhash64(x)))
    toxic = train.where("toxic = 1").select(near.alias("near"), with_stems("w").alias("w"))  # once a text, before its words are rows
    toxic = toxic.select("near", F.explode("w").alias("word"))
    groups = train.where("toxic = 1").select(near.alias("near")).distinct().count()
    words = toxic.groupBy("word").agg(F.count("*").alias("k"), F.approx_count_distinct("near", 0.02).alias("support"))
    words = stored(words.where((F.col("support") >= max(MIN_SUPPORT, min_share * groups)) & (F.col("k") >= min_share * n_toxic)).select("word", "k"))
    clean = train.where("toxic = 0").select(F.explode(with_stems("w")).alias("word"))
    clean = clean.join(F.broadcast(words.select("word")), "word").groupBy("word").agg(F.count("*").alias("c"))  # at most stems / min_share words
    ratio = F.log((F.col("k") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("c", F.lit(0)) + 0.5) / (n_clean + 1))
    best = words.join(clean, "word", "left").select("word", F.round(ratio, 6).alias("weight")).where(F.col("weight") >= min_ratio)
    found = {r.word: r.weight for r in best.collect()}
    kept: dict[str, float] = {}
    for word in sorted(found, key=lambda w: (len(w.rstrip("*")), w)):
        bare = word.rstrip("*")
        if not any(f"{bare[:k]}*" in kept for k in range(STEMS[0], len(bare) + 1)):
            kept[word] = found[word]
    return sorted(kept.items(), key=lambda x: (-x[1], x[0]))


def densities(docs: DataFrame, lexicon: list[tuple[str, float]], exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """The columns of docs but text, density, matches."""
    workers_find_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    exceptions = tuple(exceptions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, exceptions)
        for b in in_parts(batches):
            found = [density(matcher, x) for x in b["text"]]
            yield b[kept].assign(density=[x for x, _ in found], matches=[n for _, n in found])

    fields = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"]
    return docs.mapInPandas(run, ", ".join([*fields, "density double", "matches long"]))


def fit_curve(histogram: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over sqrt(density), by Newton's method on (density, toxic, rows) bins."""
    if not histogram:
        return -40.0, 0.0
    x = np.sqrt(np.array([h[0] for h in histogram]))
    y, n = (np.array([h[k] for h in histogram], float) for k in (1, 2))
    a, b = math.log((y @ n + 0.5) / ((1 - y) @ n + 0.5)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([n @ (y - p), n @ ((y - p) * x) - 1e-3 * ridge * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum(), w @ x], [w @ x, w @ (x * x)]]) + np.diag([1e-6, 1e-3 * ridge])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, matches: a row for each document; labels of held-out rows are never read."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    marks = labels.where(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * min(1.0, train_rows / max(n, 1)))
    marks = stored(marks.where(chosen))
    train = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").where("text is not null").select("text", "toxic")
    train = stored(folded_words(train).repartition(TRAIN_PARTS))
    lexicon = learn_lexicon(train)
    seen = stored(densities(docs.select("doc_id", "text"), lexicon, exceptions))
    bins = seen.join(F.broadcast(marks), "doc_id").groupBy(F.round(F.least(F.sqrt("density"), F.lit(2.0)) * BINS / 2).alias("bin"), "toxic").count().collect()
    a, b = fit_curve(sorted((float((2 * r.bin / BINS) ** 2), r.toxic, r["count"]) for r in bins))
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.sqrt("density"))))
    p = F.round(p, 9)
    return seen.select("doc_id", held_out.alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "matches")


def op4_toxicity(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
