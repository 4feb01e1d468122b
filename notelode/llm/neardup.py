"""MinHash near-duplicate detection by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Shingles are runs of five words (all words of a shorter text). Document frequencies are counted over all documents in
``buckets`` hash bins, less what rare shingles alone put into a bin; a shingle weighs its count times
ln(1 + documents / frequency), but a frequent one no less than half of a rare one, or a large group of near copies would
hide itself by making its own text frequent. ICWS draws one shingle for each of bands x rows hash functions, with chances
in proportion to weights, and once more with all weights 1: the first finds texts of like weighted shingles, the second
texts of like sets of shingles, however often one repeats them. Texts that agree on a whole band are candidates, and
candidates are linked if their weighted or their plain Jaccard similarity, computed from all their shingles, is ``least``
or more. Classes are the connected components of the links.

Exact copies are one text from the start. A bucket's texts (those that agree on a band) are decided in two passes. First
each text is compared with the bucket's leader, so a group of near copies falls into few classes at a cost in proportion
to its texts. Where texts beside the leader are still in different classes, the bucket is dealt to blocks of bounded
size, and pairs of blocks compare all their texts of different classes; of the links found there, only those that join
classes are told. So every pair of a bucket is compared, or known to be of one class; no bucket, text or pair is cut, and
no group is in one task beyond two blocks.

Null texts count as empty. Texts without words are alike only to exact copies. A class is named by its least doc_id; a row
without a doc_id takes the name of its class, or null if the class has none. Rows that share a doc_id but not the text are
different documents; each row of docs gives a row. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import DOC_COLUMNS, Scratch, in_parts, table, workers_find_package
from notelode.llm.wordhash import mixed, run_hashes, word_hashes

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 14, 4
BUCKETS = 1 << 18
#: Shingles and texts of a block, about; a pair of blocks is compared in one task.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 17, 1024
#: Cells of a matrix of texts by shingles.
CELLS = 1 << 20
#: Characters of text that a worker draws samples for at a time: small enough for a core's cache.
DRAW_CHARS = 1 << 18
HASH_BYTES = 6
LEVELS = 4096


# --- texts to weighted shingles and signatures --------------------------------------------------------------------------


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, and each text's number of them."""
    words, counts = word_hashes(texts)
    if not len(words):
        return words, counts
    runs = run_hashes(words, k)
    number = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    out = [runs[f : f + n] if n else (mixed(np.bitwise_xor.reduce(words[f : f + c] * np.arange(1, 2 * c, 2, dtype=np.uint64)).reshape(1)) if c else words[:0]) for f, n, c in zip(first.tolist(), number.tolist(), counts.tolist(), strict=True)]
    return np.concatenate(out), np.where((number == 0) & (counts > 0), 1, number)


def weighted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text in ascending order, how often each is there, and each text's number of them."""
    hashes, counts = shingles(texts)
    parts = [np.unique(x, return_counts=True) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
    if not parts:
        return hashes, np.zeros(0, np.int64), counts
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]), np.array([len(h) for h, _ in parts])


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law at the middles of LEVELS equal parts, from 1 - (1 + x) exp(-x) by bisection."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    low, high = np.zeros(LEVELS), np.full(LEVELS, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


GAMMA = _gamma_quantiles().astype(np.float32)
LOG_GAMMA = np.log(GAMMA)


def signatures(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: a key of each band's samples; counts must all be 1 or more."""
    return signatures_of(hashes, [weights], counts, bands, rows)[0]


def signatures_of(hashes: np.ndarray, weightings: list[np.ndarray], counts: np.ndarray, bands: int, rows: int) -> list[np.ndarray]:
    """The signatures by each of several weightings of the same shingles.

    A hash function has for each shingle r and c of law Gamma(2, 1) and b uniform, all from the shingle's hash. It samples
    the shingle of least log(c) - r * (t - b) - r, where t = floor(log(weight) / r + b), together with t.
    """
    log_weights = [np.log(w).astype(np.float32) for w in weightings]
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    out = [np.zeros((len(counts), bands), np.uint64) for _ in weightings]
    for k in range(bands * rows):
        x = mixed(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = GAMMA[(x & np.uint64(LEVELS - 1)).astype(np.int64)]
        log_c = LOG_GAMMA[((x >> np.uint64(12)) & np.uint64(LEVELS - 1)).astype(np.int64)]
        b = ((x >> np.uint64(24)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2**-20)
        for log_weight, keys in zip(log_weights, out, strict=True):
            t = np.floor(log_weight / r + b)
            value = log_c - r * (t - b) - r
            least = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == least[text])
            _, one = np.unique(text[at], return_index=True)
            at = at[one]
            sample = mixed(hashes[at] ^ mixed(t[at].astype(np.int64).astype(np.uint64)))
            keys[:, k // rows] = mixed(keys[:, k // rows] * np.uint64(31) + sample)
    return out


# --- similarity ---------------------------------------------------------------------------------------------------------


def packed(hashes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """A text's shingles as bytes: the low 48 bits of each hash; places and counts of those found twice or more."""
    more = np.flatnonzero(times > 1)
    low = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    return low.tobytes(), np.concatenate([more, times[more]]).astype("<u4").tobytes()


def unpacked(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(h, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    times = np.ones(len(raw), np.int64)
    places, counts = np.frombuffer(n, "<u4").reshape(2, -1)
    times[places] = counts
    return out.view(np.uint64).reshape(-1), times


def weights_of(hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(hashes % np.uint64(len(idf))).astype(np.int64)].astype(np.float64)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """The greater of the weighted and the plain Jaccard similarity of two texts' shingles and counts."""
    (h, n), (g, m) = x, y
    _, i, j = np.intersect1d(h, g, return_indices=True)
    both = (np.minimum(n[i], m[j]) * weights_of(h[i], idf)).sum()
    total = (n * weights_of(h, idf)).sum() + (m * weights_of(g, idf)).sum() - both
    return max(both / total if total else 0.0, len(i) / max(1, len(h) + len(g) - len(i)))


def linked(vecs: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, least: float) -> np.ndarray:
    """texts x texts: whether two of them are linked by either measure."""
    k = len(vecs)
    lengths = np.array([len(h) for h, _ in vecs])
    h, n = np.concatenate([h for h, _ in vecs]), np.concatenate([n for _, n in vecs])
    text = np.repeat(np.arange(k), lengths)
    size = np.bincount(text, n * weights_of(h, idf), k)
    order = np.argsort(h, kind="stable")
    h, n, text = h[order], n[order], text[order]
    own = np.cumsum(np.append(0, h[1:] != h[:-1]))
    common = np.bincount(own)[own] > 1  # shingles of one text alone add nothing
    h, n, text = h[common], n[common], text[common]
    own = np.cumsum(np.append(0, h[1:] != h[:-1])) if len(h) else own[:0]
    both, both_plain = np.zeros((k, k)), np.zeros((k, k))
    step = max(1, CELLS // k)
    for low in range(0, int(own[-1]) + 1 if len(own) else 0, step):
        i, j = np.searchsorted(own, [low, low + step])
        at, who, times = own[i:j] - low, text[i:j], n[i:j]
        weight = np.zeros(int(at[-1]) + 1)
        weight[at] = weights_of(h[i:j], idf)
        last = 0
        for level in np.unique(times).tolist():  # the lesser of two counts is the sum of the levels that both reach
            has = np.zeros((k, len(weight)))
            enough = times >= level
            has[who[enough], at[enough]] = 1
            both += (level - last) * ((has * weight) @ has.T)
            if not last:
                both_plain += has @ has.T
            last = level
    union = size[:, None] + size[None, :] - both
    union_plain = lengths[:, None] + lengths[None, :] - both_plain
    return (both >= (least - 1e-9) * union) | (both_plain >= (least - 1e-9) * union_plain)


def joins(alike: np.ndarray, comps: list) -> list[tuple]:
    """Pairs of classes that the links between texts of different classes join: of a cycle all but one."""
    names = sorted(set(comps))
    number = {c: i for i, c in enumerate(names)}
    label = np.array([number[c] for c in comps])
    out = []
    for row, own in zip(alike, range(len(comps)), strict=True):
        for other in np.unique(label[row]).tolist():
            if other != label[own]:
                out.append((names[label[own]], names[other]))
                label[label == other] = label[own]
    return out


# --- Spark --------------------------------------------------------------------------------------------------------------


def with_node(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and node, 128 bits of the text's hash: exact copies are one node."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def frequencies(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each bin, from all documents, and their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(buckets, np.int64), 0
        for b in in_parts(batches):
            hashes, counts = shingles(b["text"].tolist())
            text = np.repeat(np.arange(len(counts)), counts)
            bins = np.unique(text * buckets + (hashes % np.uint64(buckets)).astype(np.int64)) % buckets
            total += np.bincount(bins, minlength=buckets)
            rows += len(b)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bin": np.append(found, -1).astype(np.int32), "n": np.append(total[found], rows)})

    # as Arrow: a Row for each of the bins would take the driver a hundred times their bytes
    got = docs.select("text").mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins, n = got["bin"].to_numpy(), got["n"].to_numpy()
    own = bins >= 0
    out = np.zeros(buckets, np.int64)
    out[bins[own]] = n[own]
    return out, int(n[~own].sum())


def bin_weights(counts: np.ndarray, n: int) -> np.ndarray:
    """The weight of each bin's shingles, from 0.5 to 1.

    Rare shingles fill all bins about alike, by the mean and three deviations more at most; only what a bin has beyond
    that speaks of a frequent shingle.
    """
    mean = counts.mean()
    df = np.maximum(counts - mean - 3 * np.sqrt(mean), 1)
    return np.maximum(0.5, np.log1p(n / df) / np.log1p(max(n, 1))).astype(np.float32)


def sketches(docs: DataFrame, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """doc_id, node; keys and plain, the keys of the bands by weights and by weights of 1 (null without words); size, the
    number of different shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches, DRAW_CHARS):
            hashes, times, counts = weighted(b["text"].tolist())
            keys, plain = np.full(len(b), None, object), np.full(len(b), None, object)
            some = np.flatnonzero(counts)
            if len(some):
                weights = times * idf[(hashes % np.uint64(len(idf))).astype(np.int64)]
                got = signatures_of(hashes, [weights, np.ones(len(hashes), np.float32)], counts[some], bands, rows)
                for i, x, y in zip(some.tolist(), *(g.view(np.int64) for g in got), strict=True):
                    keys[i], plain[i] = x, y
            yield pd.DataFrame({"doc_id": b["doc_id"], "node": b["node"], "keys": keys, "plain": plain, "size": counts})

    return docs.mapInPandas(run, "doc_id long, node binary, keys array<long>, plain array<long>, size long")


def vectors(texts: DataFrame) -> DataFrame:
    """node, h, n: each text's shingles, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            hashes, times, counts = weighted(b["text"].tolist())
            cut = np.cumsum(counts)[:-1]
            both = [packed(h, n) for h, n in zip(np.split(hashes, cut), np.split(times, cut), strict=True)] if len(b) else []
            yield pd.DataFrame({"node": b["node"], "h": [h for h, _ in both], "n": [n for _, n in both]})

    return texts.select("node", "text").mapInPandas(run, "node binary, h binary, n binary")


def leader_links(pairs: DataFrame, vecs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Of pairs (leader, node, size) those that are linked, as (x, y).

    Pairs meet in groups of a leader and a salt, of bounded size; in each the leader comes first, and the others stream by.
    """
    salts = pairs.groupBy("leader").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("salts"))
    pairs = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node", F.lit(1).alias("turn"))
    heads = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"), F.lit(0).alias("turn"))
    groups = pairs.unionByName(heads).join(vecs, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for b in batches:
            found = []
            for leader, turn, node, h, n in zip(b["leader"], b["turn"], b["node"], b["h"], b["n"], strict=True):
                own = unpacked(h, n)
                if not turn:
                    head = own
                elif similarity(head, own, idf) >= least - 1e-9:
                    found.append((leader, node))
            yield pd.DataFrame(found, columns=["x", "y"])

    return groups.mapInPandas(run, "x binary, y binary")


def block_links(members: DataFrame, vecs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Of members (bucket, node, comp, blocks) the pairs (x, y) of classes that links within buckets join."""
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if b["comp"].nunique() > 1:
            alike = linked([unpacked(h, n) for h, n in zip(b["h"], b["n"], strict=True)], idf, least)
            found = joins(alike, b["comp"].tolist())
        return pd.DataFrame(found, columns=["x", "y"])

    return rows.join(vecs, "node").groupBy("bucket", "i", "j").applyInPandas(run, "x binary, y binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp: for each node of links (x, y) the least node that is linked with it, over any number of links.

    Each round takes the least label among neighbours and then jumps to the label's own label, so long chains halve.
    """
    ways = scratch.stored(links.selectExpr("x as u", "y as v").union(links.selectExpr("y as u", "x as v")).distinct())
    kept = scratch.stored(ways.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as node", "least(u, m) as comp"))
    while True:
        labels = kept.select("node", "comp")
        near = ways.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").selectExpr("node", "comp as old", "least(comp, m) as comp")
        jump = labels.selectExpr("node as comp", "comp as far")
        lower = scratch.stored(lower.join(jump, "comp").selectExpr("node", "old", "least(comp, far) as comp"))
        scratch.drop(kept)
        kept = lower
        if lower.where("comp <> old").isEmpty():
            scratch.drop(ways)
            return lower.select("node", "comp")


def components_of(texts: DataFrame, docs: DataFrame, idf: np.ndarray, least: float, scratch: Scratch) -> DataFrame:
    """node, comp for the texts (node, first, keys, plain, size) that are linked to others; docs has doc_id, node and text."""
    sides = F.array(F.struct(F.lit(0).alias("measure"), "keys"), F.struct(F.lit(1).alias("measure"), F.col("plain").alias("keys")))
    rows = texts.where("keys is not null").select("node", "size", F.explode(sides).alias("side"))
    rows = rows.select("node", "size", "side.measure", F.posexplode("side.keys").alias("band", "key"))
    rows = rows.select(F.xxhash64("measure", "band", "key").alias("bucket"), "node", "size")
    heads = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    # merge joins at any size: all of these tables grow with the documents
    members = scratch.stored(rows.hint("merge").join(heads, "bucket"))
    pairs = scratch.stored(members.where("node <> leader").select("leader", "node", "size").distinct())
    # of a text's copies the one with the least doc_id; by text and doc_id, so many copies do not meet in one task
    needed = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", id_or_none("first").alias("id"))
    one_of_each = docs.select("node", id_or_none("doc_id").alias("id"), "text").hint("merge").join(needed, ["node", "id"], "left_semi")
    vecs = scratch.stored(vectors(one_of_each.dropDuplicates(["node", "id"])))
    comps = components(leader_links(pairs, vecs.hint("merge"), idf, least), scratch)
    others = members.where("node <> leader").select("bucket", "node", "size")
    others = others.hint("merge").join(comps, "node", "left").select("bucket", "node", "size", F.coalesce("comp", "node").alias("comp"))
    others = scratch.stored(others)
    blocks = F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int")
    several = others.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("bucket", "blocks")
    open_ones = others.drop("size").hint("merge").join(several, "bucket")
    wider = components(block_links(open_ones, vecs.hint("merge"), idf, least), scratch).selectExpr("node as comp", "comp as wide")
    out = comps.union(wider.selectExpr("comp as node", "comp").join(comps.select("node"), "node", "left_anti"))  # texts that only blocks linked
    out = scratch.stored(out.join(wider, "comp", "left").select("node", F.coalesce("wide", "comp").alias("comp")))
    scratch.drop(members, pairs, vecs, others)
    return out


def grouped(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, node, comp, class_id: a row for each row of docs; comp and class_id tell the class, by node and by doc_id."""
    workers_find_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    counts, n = frequencies(docs, buckets)
    idf = bin_weights(counts, n)
    docs = with_node(docs)
    once = sketches(docs, idf, bands, rows).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("keys", "plain", "size")))
    texts = scratch.stored(once)
    comps = components_of(texts, docs, idf, least, scratch)
    own = texts.select("node", "first", "n").join(comps, "node", "left")
    linked_ones = own.where("comp is not null").select("node", "comp", "first")
    named = linked_ones.groupBy("comp").agg(F.min("first").alias("class_id"))
    classes_of = linked_ones.join(named, "comp").select("node", "comp", "class_id")
    copies = own.where("comp is null and n > 1").select("node", F.col("node").alias("comp"), F.col("first").alias("class_id"))
    classes_of = scratch.stored(classes_of.union(copies))
    scratch.drop(texts, comps)
    out = docs.select("doc_id", "node").hint("merge").join(classes_of, "node", "left")
    return out.select("doc_id", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("class_id", "doc_id").alias("class_id"))


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, class_id: a row for each row of docs."""
    return grouped(docs, least, bands, rows, buckets).select("doc_id", "class_id")


def op10_minhash_icws(spark, sf_dir) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def neardup_stage(spark, docs, sf_dir) -> DataFrame:
    """Of each class the document with the least doc_id; null doc_ids come last, then the least hash of the text decides.

    Different texts that share a doc_id are different documents; of rows that repeat a doc_id and text one stays. Documents
    with a null or empty text are copies of each other. An empty table gives an empty result; extra columns are left out.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    keep = grouped(docs).groupBy("comp").agg(F.min(order).alias("k")).select(key_of("k.doc_id", "k.node").alias("key"))
    rows = docs.select(*DOC_COLUMNS)
    rows = rows.withColumn("key", key_of("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit(""))))))
    return rows.hint("merge").join(keep, "key", "left_semi").dropDuplicates(["key"]).select(*DOC_COLUMNS)


def id_or_none(doc_id: str) -> F.Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))


def key_of(doc_id, node) -> F.Column:
    """128 bits that tell a doc_id (or null) and a text's node."""
    return F.unhex(F.md5(F.concat(F.hex(node), id_or_none(doc_id))))
