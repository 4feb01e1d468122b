"""Substring dedup by repeated-phrase automata.

A window of ``width`` words is removed where its words also start in a document with a smaller doc_id. Three steps:

1. Find: the least hash of the 8-word runs of a window is its anchor; equal windows have equal anchors, and a stretch of
   windows has one in common, so each stretch is one row: anchor and 128 bits of the stretch. Anchors met in two documents
   are looked into. A stretch that is met whole in a smaller document recurs whole; only where stretches of an anchor
   differ, as at a passage's ends, are single windows compared. Sums over keys are made before each shuffle, and joins
   are by merge, which splits hot keys; copies in thousands are one row a stretch and task.
2. Compile: documents that name recurring passages are dealt to shards by the document that has most of theirs first, so
   copies share a shard, and a hot one is dealt to several. The first document of each passage gives its very words to
   every shard that names the passage, and each shard compiles one Aho-Corasick automaton over words with pyahocorasick.
3. Stream: all documents run through their shard's automaton. Only what it finds, word by word, is removed: the passage
   must come from a document with a smaller doc_id. Hashes alone remove nothing.

A shard holds the passages that about ``SHARD_DOCS`` documents name, and texts stream by. Null and empty texts have no
words, remove none and keep the empty string. Rows that share a doc_id count as one document. A null doc_id neither
removes nor is removed. Texts shorter than a window stay whole. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import Scratch, in_parts, table, workers_find_package
from notelode.llm.wordhash import mixed, powers, run_hashes, word_hashes

WIDTH = 50
ANCHOR = 8
#: Documents of a shard, about.
SHARD_DOCS = 300
_SECOND = np.uint64(0xA0761D6478BD642F)


def least_of_runs(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    n, width = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[k - width : k - width + n])


class Stretches:
    """The windows of a batch of texts, and the stretches of windows with one anchor."""

    def __init__(self, texts: list[str | None], width: int):
        words, self.counts = word_hashes(texts)
        self.windows = run_hashes(words, width)  # of all start words, also over the ends of texts
        anchors = least_of_runs(run_hashes(words, min(ANCHOR, width)), width - min(ANCHOR, width) + 1)
        self.first = np.cumsum(self.counts) - self.counts  # word at which each text begins
        number = np.maximum(self.counts - width + 1, 0)
        text = np.repeat(np.arange(len(texts)), number)
        at = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + self.first[text]
        self.at, self.text = at, text  # start word and text of each window inside a text
        own = anchors[at]
        change = np.ones(len(at), bool)
        change[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        self.begin = np.flatnonzero(change)  # windows at which stretches begin
        self.of = np.cumsum(change) - 1  # each window's stretch
        self.size = np.diff(np.append(self.begin, len(at)))  # windows of each stretch
        self.anchor = own[self.begin].view(np.int64)
        self.hash, self.stretch = self.keys(self.windows[at])
        self.hash2, self.stretch2 = self.keys(run_hashes(mixed(words ^ _SECOND), width)[at])  # a second, independent 64 bits

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window and of each stretch."""
        up, down = powers(len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
        whole = mixed((sums[self.begin + self.size] - sums[self.begin]) * down[self.begin] + self.size.astype(np.uint64))
        return h.view(np.int64), whole.view(np.int64)


def find_stretches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, anchor, k1, k2: a row for each stretch of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            s = Stretches(b["text"].tolist(), width)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[s.text[s.begin]], "anchor": s.anchor, "k1": s.stretch, "k2": s.stretch2})

    return docs.mapInPandas(run, "doc_id long, anchor long, k1 long, k2 long")


def find_windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k1, k2: the windows of the stretches in the column doubtful of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            s = Stretches(b["text"].tolist(), width)
            wanted = np.zeros(len(s.begin), bool)
            for own, (lo, hi) in zip(b["doubtful"], split_by_text(s.text[s.begin], len(b)), strict=True):
                wanted[lo:hi] = np.isin(s.stretch[lo:hi], np.asarray(own, np.int64))
            hit = np.flatnonzero(wanted[s.of])
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[s.text[hit]], "k1": s.hash[hit], "k2": s.hash2[hit]}).drop_duplicates()

    return docs.mapInPandas(run, "doc_id long, k1 long, k2 long")


def split_by_text(text: np.ndarray, n: int) -> list[tuple[int, int]]:
    """First and last place of each of n texts in ascending numbers of texts."""
    bounds = np.searchsorted(text, np.arange(n + 1))
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def recurring(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """doc_id, k1, k2, first: stretches and windows of each document that start in a smaller document, first."""
    rows = scratch.stored(find_stretches(docs, width))
    hot = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("k1") < F.max("k1")).alias("differ"))
    met = scratch.stored(rows.join(hot.where("lo < hi").select("anchor", "differ"), "anchor").select("doc_id", "k1", "k2", "differ").distinct())
    scratch.drop(rows)
    firsts = met.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    rows = scratch.stored(met.join(firsts, ["k1", "k2"]))
    scratch.drop(met)
    whole = rows.where("first < doc_id").select("doc_id", "k1", "k2", "first")
    doubtful = scratch.stored(rows.where("first = doc_id and differ").groupBy("doc_id").agg(F.collect_set("k1").alias("doubtful")))
    windows = scratch.stored(find_windows(docs.hint("merge").join(doubtful, "doc_id"), width))
    firsts = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    single = windows.join(firsts, ["k1", "k2"]).where("first < doc_id").select("doc_id", "k1", "k2", "first")
    found = scratch.stored(whole.union(single))
    scratch.drop(rows, doubtful, windows)
    return found


def dealt(found: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, shard, keys: a row without keys for each document that is to run through a shard; with keys, those of the
    document's passages that it gives to the shard."""
    homes = scratch.stored(found.groupBy("doc_id").agg(F.min("first").alias("home")))
    shards = max(1, homes.count() // SHARD_DOCS)
    salts = homes.groupBy("home").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("salts"))
    shard = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), "salts")), F.lit(shards))
    streams = scratch.stored(homes.join(salts, "home").select("doc_id", shard.alias("shard")))
    named = found.join(streams, "doc_id").select("shard", "first", "k1", "k2").distinct()
    gives = scratch.stored(named.groupBy("shard", F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("k1", "k2")).alias("keys")))
    only = gives.select("doc_id").distinct().join(streams, "doc_id", "left_anti")  # these stream too, without a shard
    streams = streams.withColumn("keys", F.lit(None).cast(gives.schema["keys"].dataType))
    return scratch.stored(streams.unionByName(gives).unionByName(only, allowMissingColumns=True))


def routed(docs: DataFrame, width: int) -> DataFrame:
    """From docs (doc_id, text, shard, keys) the rows that shards read: passages (turn 0; text: their words, one run after
    the other; starts and sizes of the patterns in it) and documents (turn 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            out = b[["shard", "doc_id", "text"]].copy()
            out["turn"], out["starts"], out["sizes"] = 1, None, None
            gives = np.flatnonzero(b["keys"].notna().to_numpy())
            texts = [b["text"].iloc[i] for i in gives]
            s = Stretches(texts, width)
            windows, stretches = split_by_text(s.text, len(texts)), split_by_text(s.text[s.begin], len(texts))
            for i, text, (lo, hi), (low, high), first in zip(gives.tolist(), texts, windows, stretches, s.first.tolist(), strict=True):
                keys = {(k["k1"], k["k2"]) for k in b["keys"].iloc[i]}
                spans = {(int(s.at[k]) - first, width) for k in range(lo, hi) if (s.hash[k], s.hash2[k]) in keys}
                spans |= {(int(s.at[s.begin[k]]) - first, int(s.size[k]) + width - 1) for k in range(low, high) if (s.stretch[k], s.stretch2[k]) in keys}
                words = (text or "").split() if (text or "").isascii() else [x.decode("utf-8", "surrogatepass") for x in (text or "").encode("utf-8", "surrogatepass").split()]
                kept, starts, sizes, end, shift = [], [], [], 0, 0
                for start, size in sorted(spans):
                    if start > end:
                        shift += start - end
                    kept += words[max(start, end) : start + size]
                    end = max(end, start + size)
                    starts.append(start - shift)
                    sizes.append(size)
                for column, value in (("turn", 0), ("text", " ".join(kept)), ("starts", np.array(starts, "<i4").tobytes()), ("sizes", np.array(sizes, "<i4").tobytes())):
                    out.iat[i, out.columns.get_loc(column)] = value
            yield out.astype({"doc_id": "Int64", "shard": "Int64"})

    return docs.mapInPandas(run, "shard long, doc_id long, text string, turn int, starts binary, sizes binary")


class Passages:
    """A shard's passages, compiled once when the first document comes."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.first: dict[tuple[int, ...], int] = {}
        self.automaton = None

    def add(self, doc: int, words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> None:
        ids = tuple([self.number.setdefault(w, len(self.number) + 1) for w in words])
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            own = ids[start : start + size]
            self.first[own] = min(doc, self.first.get(own, doc))

    def marked(self, doc: int, words: list[bytes]) -> bytearray | None:
        """1 for each word of the document that a passage of a smaller document covers."""
        import ahocorasick

        if not self.first:
            return None
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for own, first in self.first.items():
                self.automaton.add_word(own, (len(own), first))
            self.automaton.make_automaton()
        mark = bytearray(len(words))
        get = self.number.get
        for end, (n, first) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            if first < doc:
                mark[end + 1 - n : end + 1] = b"\1" * n
        return mark


def removed(rows: DataFrame, each: bool) -> DataFrame:
    """From rows sorted by shard and turn: doc_id, n_words, n_removed, kept_sha256, and with each kept (the text)."""
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, passages = None, Passages()
        for b in in_parts(batches):
            out = []
            for own, doc, text, turn, starts, sizes in zip(b["shard"], b["doc_id"], b["text"], b["turn"], b["starts"], b["sizes"], strict=True):
                if own != shard:
                    shard, passages = own, Passages()
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if not turn:
                    passages.add(doc, words, np.frombuffer(starts, "<i4"), np.frombuffer(sizes, "<i4"))
                    continue
                mark = passages.marked(doc, words) if own >= 0 else None
                gone = mark.count(1) if mark else 0
                raw = b" ".join([w for w, m in zip(words, mark, strict=True) if not m] if gone else words)
                out.append((None if doc != doc else doc, len(words), gone, hashlib.sha256(raw).hexdigest(), *([raw.decode("utf-8", "surrogatepass")] if each else [])))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * each]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, fields)


def dedup(docs: DataFrame, width: int = WIDTH, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept): a row for each row of docs."""
    workers_find_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = recurring(docs.where("doc_id is not null"), width, scratch)
    roles = dealt(found, scratch)
    rows = routed(docs.hint("merge").join(roles, "doc_id", "left"), width)
    # documents that name no passage are spread over shards without one
    spread = -1 - F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20))
    rows = rows.withColumn("shard", F.coalesce("shard", spread)).repartition("shard").sortWithinPartitions("shard", "turn")
    return removed(rows, text)


def op3_phrase_automata(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
