"""Importance resampling of documents towards a target distribution of hashed word runs.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters; features are all runs of one to
three consecutive words of a text, joined by a space, repeats counted. A worker takes up texts of bounded size at a time and
puts them into a trie, level by level: a node is its parent and a word, and holds the count of its feature and the CRC-32 of
the path so far, from which that of each child is continued. Counts of nodes go to buckets (the CRC modulo ``buckets``), and a
task gives one row for each bucket it met. The totals of both tables make the gain of every bucket; they have at most
``buckets`` rows, so they reach the driver and go back with the functions. A second pass builds the tries again, attaches to
each node the gain of its path, and a document's weight is the sum over its paths.

Scores add Gumbel noise drawn from the doc_id. The best are drawn by ranges: documents are dealt to partitions by range of
(score, doc_id), counts of partitions tell each one's first rank, and only partitions with drawn documents are numbered.

Null and empty texts have no words, weigh 0 and are not drawn. A null doc_id hashes as an empty one, and orders last among
equals. Repeated rows count as rows; rows of one doc_id and score have ranks in any order. Very long texts are taken whole, one
at a time. An empty corpus gives an empty result; an empty target gives gains all the same. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.llm.base import Scratch, in_parts, table, workers_find_package

BUCKETS, DEPTH, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes that part words become a space; A-Z become a-z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320


def _zeros() -> np.ndarray:
    """For each k, tables that carry a CRC-32 register over 2 ** k zero bytes, a byte of the register at a time."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    start = np.arange(256, dtype=np.uint32)
    step = [(v >> np.uint32(8)) ^ one[v & 255] for v in (start << np.uint32(8 * j) for j in range(4))]
    out = [np.stack(step)]
    for _ in range(31):
        out.append(np.stack([carried(out[-1], x) for x in out[-1]]))
    return np.stack(out)


def carried(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


_ZEROS = _zeros()


def continued(crc: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """CRC-32 of prefixes (crc), each followed by bytes whose number and CRC-32 are given."""
    crc = crc.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> k & 1)
        crc[at] = carried(_ZEROS[k], crc[at])
    return crc ^ own


class Tries:
    """The trie of some texts: for each level the parent, word, count and CRC state of its nodes, and each place's node."""

    def __init__(self, texts: list[str | None], depth: int = DEPTH):
        split = [(t or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() for t in texts]
        self.n_words = np.array([len(x) for x in split], np.int64)
        words = np.empty(int(self.n_words.sum()), object)
        words[:] = list(chain.from_iterable(split))
        self.text = np.repeat(np.arange(len(texts)), self.n_words)
        at, names = pd.factorize(words)
        self.words = len(names)
        child = np.array([zlib.crc32(b" " + w) for w in names], np.uint32)
        size = np.array([len(w) + 1 for w in names], np.int64)
        crc = np.array([zlib.crc32(w) for w in names], np.uint32)
        #: (node of each place that has one, its parent's node, count of each node, CRC of each node)
        self.levels = [(at, np.zeros(len(names), np.int64), np.bincount(at, minlength=len(names)), crc)]
        for d in range(1, depth):
            node, _, _, state = self.levels[-1]
            n = len(words) - d
            if n <= 0:
                break
            fits = self.text[:n] == self.text[d:]
            key = np.where(fits, node[:n] * self.words + at[d:], -1)
            place, keys = pd.factorize(key[fits])
            parent, word = np.divmod(keys, max(1, self.words))
            here = np.full(len(words), -1)
            here[:n][fits] = place
            self.levels.append((here, parent, np.bincount(place, minlength=len(keys)), continued(state[parent], size[word], child[word])))

    def totals(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(buckets, np.int64)
        for _, _, count, crc in self.levels:
            np.add.at(out, crc % np.uint32(buckets), count)
        return out

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of gains of each text's features: that of the deepest node's path at each of its places."""
        path, best = None, np.zeros(len(self.text), np.int64)
        for node, parent, _, crc in self.levels:
            own = gains[crc % np.uint32(len(gains))]
            path = own if path is None else own + path[parent]
            there = node >= 0
            best[there] = path[node[there]]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(best)))
        ends = np.cumsum(self.n_words)
        return sums[ends] - sums[ends - self.n_words]


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(buckets, np.int64)
        for b in in_parts(batches):
            out += Tries(b["text"].tolist()).totals(buckets)
        met = np.flatnonzero(out)
        yield pd.DataFrame({"bucket": met, "n": out[met]})

    sums = [0] * buckets
    for r in texts.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets rows
        sums[r["bucket"]] = r["n"]
    return sums


def gains_of(source: list[int], target: list[int]) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    n = len(source)
    all_s, all_t = float(sum(source) + n), float(sum(target) + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            t = Tries(b["text"].tolist())
            features = sum(np.maximum(0, t.n_words - d) for d in range(DEPTH))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": t.n_words, "n_features": features, "weight": t.weights(gains)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (of the drawn, else null): a row for each row of docs."""
    workers_find_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    gains = gains_of(bucket_totals(docs, buckets), bucket_totals(target, buckets))
    scored = weighed(docs, gains).withColumn("score", (F.col("weight") + noise(seed)).cast("long"))
    scored = scratch.stored(scored)
    fits = F.col("n_words") >= least
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # ranges of the order, each with a number, as they were dealt
    dealt = scratch.stored(scored.where(fits).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    drawn = percent * sum(counts.values()) // 100
    before, at = {}, 0
    for part in sorted(counts):
        if at < drawn:
            before[part] = at
        at += counts[part]
    fields = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    rest = scored.where(~fits).select(*fields, none)
    if not before:
        return rest.unionByName(dealt.select(*fields, none))
    last = max(before)  # parts are in order, so those with drawn documents come first
    starts = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(last + 1)]), F.col("part") + 1)
    rank = starts + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    top = dealt.where(F.col("part") <= last).withColumn("rank", rank.cast("long")).select(*fields, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return rest.unionByName(dealt.where(F.col("part") > last).select(*fields, none)).unionByName(top)


def op13_importance_tries(spark, sf_dir) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same from the words themselves; a CRC-32 goes over the bytes of each different feature once.
SQL = f"""WITH RECURSIVE bits AS (SELECT b::UBIGINT AS b, b::UBIGINT AS c, 0 AS turn FROM range(256) AS t(b) UNION ALL
SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}::UBIGINT) ELSE c >> 1 END, turn + 1 FROM bits WHERE turn < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY b) AS steps FROM bits WHERE turn = 8),
texts AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT item_id, text, false FROM benchmark)),
split AS MATERIALIZED (SELECT i, doc_id, own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM texts),
runs AS MATERIALIZED (SELECT i, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]), list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) AS f FROM split),
counts AS MATERIALIZED (SELECT i, own, f, count(*) AS n FROM runs GROUP BY ALL),
codes AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(f)) + 1), lambda k: ('0x' || substr(hex(encode(f)), 2 * k - 1, 2))::UBIGINT)), lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM counts), steps),
known AS MATERIALIZED (SELECT i, own, bucket, n FROM counts JOIN codes USING (f)),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM known GROUP BY bucket),
sums AS (SELECT coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM known),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln((totals.t + 1) * (sums.s + {BUCKETS}) / ((totals.s + 1) * (sums.t + {BUCKETS}))))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT i, sum(n * gain)::BIGINT AS weight FROM known JOIN gains USING (bucket) WHERE own GROUP BY i),
scored AS (SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM split LEFT JOIN weights USING (i) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked"""
