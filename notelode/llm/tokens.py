"""Token ids in patched frame-of-reference blocks.

A shard file holds the ids of a run of documents in ascending doc_id order. Ids are cut into blocks of 128. A block keeps
its minimum; the differences are packed at the width that ``percentile`` of them fit, wider ones go to an exception list
of positions and high parts. Layout, little-endian:

    header   magic "PFOR", version u32, documents u64, ids u64, blocks u64, bytes of data u64
    docs     doc_id i64 and end u64 (ids up to and with this document) of each document
    index    start u64 of each block within data
    data     blocks: ids n u16, width u8, exceptions u16, minimum u32, packed words, positions u8, high parts u32
    crc      crc32 u32 of all before

Documents are dealt to tasks by ranges of doc_id, and a task begins a new shard whenever one is full, so neither many
rows of one doc_id nor long texts make a task hold more than a shard and a batch. Each shard is written under a name of
its own attempt and then renamed, so a lost executor leaves no half file behind. The numbers of ids before each shard are
summed in three levels (groups of tasks, tasks, shards); nothing of a shard goes to the driver.

Ids come from the tokenizers library. Its pre-tokenizer never joins two sides of a single space between non-space
characters, so texts are cut there and pieces met before are looked up by their bytes; others go through the library.

Null and empty texts have the end id alone. Repeated rows are documents of their own; documents of one doc_id stand in
order of a hash of their texts. An empty table gives no files and an empty result. Extra columns are ignored; a null doc_id
sorts first and comes back as null.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.llm.base import Scratch, in_parts, shared_dir, table, workers_find_package

BLOCK = 128
PERCENTILE = 90
#: Characters of text for each task, about, and ids after which a shard is full.
SHARD_CHARS = 16 << 20
SHARD_IDS = 2 << 20
#: Characters that a worker takes up at a time.
PART_CHARS = 3 << 20
#: Tasks that read shards, at most; each reads one file after another.
READ_TASKS = 20_000
#: Tasks whose ids are summed as one group.
GROUP = 1024
#: Pieces that a worker remembers, about: those met lately, and half as many met before.
MEMORY = 1_000_000
NULL_ID = -(1 << 63)
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sIQQQQ")
BLOCK_HEAD = np.dtype([("n", "<u2"), ("width", "u1"), ("exceptions", "<u2"), ("minimum", "<u4")])


# --- the format -----------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ids and the start of each; all blocks of a width are packed together."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, "<u8")
    k = -(-n // BLOCK)
    full = np.full(k * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(k, BLOCK)
    sizes = np.full(k, BLOCK)
    sizes[-1] = n - (k - 1) * BLOCK
    low = full.min(axis=1)
    diff = (full - low[:, None]).astype(np.uint64)
    at = -(-BLOCK * percentile // 100) - 1
    width = np.ceil(np.log2(np.partition(diff, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint64)
    high = diff >> width[:, None]
    outlier = high > 0
    outlier[-1, sizes[-1] :] = False
    n_out = outlier.sum(axis=1)
    head = np.empty(k, BLOCK_HEAD)
    head["n"], head["width"], head["exceptions"], head["minimum"] = sizes, width, n_out, low
    packed = width.astype(np.int64) * (BLOCK // 8)
    lengths = BLOCK_HEAD.itemsize + packed + 5 * n_out
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.zeros(lengths.sum(), np.uint8)
    out[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)] = head.view(np.uint8).reshape(k, -1)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            words = np.zeros((2 * w, len(rows)), np.uint64)
            low_bits = np.ascontiguousarray((diff[rows] & np.uint64((1 << w) - 1)).T)
            for i in range(BLOCK):
                j, shift = divmod(i * w, 64)
                words[j] |= low_bits[i] << np.uint64(shift)
                if shift + w > 64:
                    words[j + 1] |= low_bits[i] >> np.uint64(64 - shift)
            raw = np.ascontiguousarray(words.T.astype("<u8")).view(np.uint8).reshape(len(rows), -1)
            out[(starts[rows] + BLOCK_HEAD.itemsize)[:, None] + np.arange(16 * w)] = raw
    block, where = np.nonzero(outlier)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        lists = (starts + BLOCK_HEAD.itemsize + packed)[block]
        out[lists + rank] = where
        out[(lists + n_out[block] + 4 * rank)[:, None] + np.arange(4)] = high[block, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype("<u8")


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks of data (bytes) that begin at starts; any part of the index gives its blocks alone."""
    k, size = len(starts), BLOCK_HEAD.itemsize
    starts = starts.astype(np.int64)
    head = np.ascontiguousarray(data[starts[:, None] + np.arange(size)]).view(BLOCK_HEAD).reshape(-1)
    width, n_out = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((k, BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            raw = data[(starts[rows] + size)[:, None] + np.arange(16 * w)]
            words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
            got = np.empty((BLOCK, len(rows)), np.uint64)
            for i in range(BLOCK):
                j, shift = divmod(i * w, 64)
                got[i] = words[j] >> np.uint64(shift)
                if shift + w > 64:
                    got[i] |= words[j + 1] << np.uint64(64 - shift)
            out[rows] = (got & np.uint64((1 << w) - 1)).T
    block = np.repeat(np.arange(k), n_out)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        lists = (starts + size + 16 * width)[block]
        high = np.ascontiguousarray(data[(lists + n_out[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        out[block, data[lists + rank]] |= high.astype(np.uint64) << width[block].astype(np.uint64)
    out += head["minimum"][:, None].astype(np.uint64)
    return out.astype(np.uint32)[np.arange(BLOCK) < head["n"][:, None]]


def encode_shard(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    data, starts = pack(ids)
    docs = np.empty(len(doc_ids), [("doc_id", "<i8"), ("end", "<u8")])
    docs["doc_id"], docs["end"] = doc_ids, ends
    body = HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(starts), len(data)) + docs.tobytes() + starts.tobytes() + data
    return body + struct.pack("<I", zlib.crc32(body))


def decode_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ends and ids of a shard file, after its checksum was checked."""
    if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a shard file fails its checksum")
    magic, _, n_docs, n_ids, n_blocks, _ = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    docs = np.frombuffer(raw, [("doc_id", "<i8"), ("end", "<u8")], n_docs, HEAD.size)
    at = HEAD.size + 16 * n_docs
    starts = np.frombuffer(raw, "<u8", n_blocks, at)
    ids = unpack(np.frombuffer(raw, np.uint8, offset=at + 8 * n_blocks)[:-4], starts) if n_blocks else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("a shard file holds another number of ids than it says")
    return docs["doc_id"], docs["end"], ids


# --- the tokenizer ----------------------------------------------------------------------------------------------------

_worker: dict = {}
_ODD = np.zeros(256, bool)  # last bytes of white space beyond ASCII
_ODD[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEFORE = np.zeros(256, bool)  # the bytes before those
_BEFORE[[0xC2, 0x9A, 0x80, 0x81]] = True
_LEAD = np.zeros(256, bool)  # first bytes of characters that may be white space
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[128:] = True
_FACTOR = 0x9E3779B97F4A7C15


class Met:
    """Pieces and their ids, one after the other."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.begin, self.count, self.ids = array("q"), array("q"), array("I")

    def keep(self, names: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places of new pieces."""
        first = len(self.begin)
        self.begin.frombytes((len(self.ids) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.count.frombytes(counts.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.place.update(zip(names, range(first, first + len(names)), strict=True))
        return np.arange(first, first + len(names))

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at places, one after the other, and their numbers."""
        begin, count, ids = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((self.begin, np.int64), (self.count, np.int64), (self.ids, np.uint32)))
        n = count[places]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return ids[np.repeat(begin[places], n) + step], n


class Pieces:
    """The library's tokenizer and the pieces met so far, once for each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        size = self.of.get_vocab_size()
        self.n_bytes = np.array([len(self.of.id_to_token(i) or "") for i in range(size)], np.int64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.now, self.before = Met(), Met()

    def powers(self, n: int) -> None:
        """Powers of an odd factor and of its inverse, modulo 2 ** 64, for n bytes at least."""
        if len(self.up) < n:
            n += n // 4
            self.up, self.down = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def learn(self, names: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of new pieces, their ids one after the other in that order, and their numbers. Many plain ones (a space before, none at the end) go to the library as one
        text: it cuts them apart again where they were joined."""
        order, parts, counts, rest = [], [], [], np.flatnonzero(~plain).tolist()
        where = np.flatnonzero(plain)
        for at in range(0, len(where), 4000):
            own = where[at : at + 4000].tolist()
            joined = b"".join([names[i] for i in own]).decode("utf-8", "surrogatepass")
            ids = np.array(self.of.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(names[i]) for i in own])
            reached = np.cumsum(self.n_bytes[ids])
            cut = np.searchsorted(reached, ends) + 1
            if reached[-1] == ends[-1] and (reached[cut - 1] == ends).all():
                order.append(own)
                parts.append(ids)
                counts.append(np.diff(cut, prepend=0))
            else:
                rest += own
        if rest:
            got = [e.ids for e in self.of.encode_batch_fast([names[i].decode("utf-8", "surrogatepass") for i in rest], add_special_tokens=False)]
            order.append(rest)
            parts.append(np.array([x for ids in got for x in ids], np.uint32))
            counts.append(np.array(list(map(len, got)), np.int64))
        return np.concatenate(order).astype(np.int64), np.concatenate(parts), np.concatenate(counts)

    def places(self, names: list[bytes], plain: np.ndarray) -> np.ndarray:
        """The places of pieces among those met lately; pieces met before are taken over, others learned."""
        if len(self.now.place) > MEMORY // 2:
            self.now, self.before = Met(), self.now
        known = np.fromiter(map(self.now.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            old = np.fromiter(map(self.before.place.get, [names[i] for i in new.tolist()], repeat(-1)), np.int64, len(new))
            again, new = new[old >= 0], new[old < 0]
            if len(again):
                known[again] = self.now.keep([names[i] for i in again.tolist()], *self.before.ids_of(old[old >= 0]))
            if len(new):
                order, ids, counts = self.learn([names[i] for i in new.tolist()], plain[new])
                known[new[order]] = self.now.keep([names[i] for i in new[order].tolist()], ids, counts)
        return known

    @staticmethod
    def equal(keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces (data from starts to ends, and a hash of each) those that come first, and which of them each equals.

        Pieces of one hash are compared byte by byte; one that differs from the first of its hash stands for itself.
        """
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        size = ends - starts
        same = size == size[first][of]
        span = np.where(same, size, 0)
        # pieces are neighbours in data: each byte is held against the byte at its place in the first piece
        shift = np.repeat(starts[first][of] - starts, span)
        at = np.arange(len(data)) if same.all() else np.repeat(starts - np.cumsum(span) + span, span) + np.arange(span.sum())
        unlike = data[at] != data[at + shift]
        if unlike.any() or not same.all():
            odd = np.union1d(np.flatnonzero(~same), np.unique(np.searchsorted(starts, at[unlike], side="right") - 1))
            of = of.copy()
            of[odd] = len(first) + np.arange(len(odd))
            first = np.append(first, odd)
        return first, of

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of each text's ids."""
        raws = [x.encode("utf-8", "surrogatepass") for x in texts]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        raw = b"".join(raws)
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        if not n:
            return np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
        self.powers(n + 1)
        at = np.flatnonzero(data == 32)
        at = at[(at > 1) & (at < n - 1)]
        before, after = data[at - 1], data[at + 1]
        at = at[_SOLID[before] & _SOLID[after] & ~(_ODD[before] & _BEFORE[data[at - 2]]) & ~_LEAD[after]]
        firsts = np.concatenate(([0], np.cumsum(lengths)))
        begins = np.zeros(n, bool)
        begins[at] = begins[firsts[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.up[:n])))
        keys = (sums[ends] - sums[starts]) * self.down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(56))
        first, of = self.equal(keys, data, starts, ends)
        names = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        # pieces that begin at a cut and end before one, not with a text, have neither white space after their own nor at the end
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        plain = (cut[starts] & cut[ends])[first]
        piece = self.places(names, plain)[of]
        ids, count = self.now.ids_of(piece)
        # ids go behind those of the pieces before, with one place left for the end id of each text before
        text = np.searchsorted(firsts[1:], starts, side="right")
        target = np.cumsum(count) - count + text
        total = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(total.sum(), end_id, np.uint32)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(target, count) + step] = ids
        return out, total


def encode(texts: list[str], path: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts as the library gives them, each followed by the end id, and their numbers."""
    if _worker.get("path") != path:
        _worker.update(path=path, pieces=Pieces(path))
    return _worker["pieces"].encode(texts, end_id)


# --- Spark ------------------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, vocabulary: str, shard_chars: int = SHARD_CHARS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write documents in ascending doc_id order to shard files in folder; returns part, k, file, n_ids: a row a file, in
    order of part and k."""
    spark = docs.sparkSession
    workers_find_package(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, chars // shard_chars)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        task = TaskContext.get()
        doc_ids, counts, ids, held, k = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            raw = encode_shard(np.concatenate(doc_ids), np.cumsum(np.concatenate(counts)), np.concatenate(ids))
            name = f"shard-{task.partitionId():08d}-{k:05d}.pfor"
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tried := f"{root}/_{name}.{task.taskAttemptId()}") as f:
                f.write(raw)
            store.move(tried, f"{root}/{name}")
            return pd.DataFrame({"part": [task.partitionId()], "k": [k], "file": [name], "n_ids": [held]})

        for b in in_parts(batches, PART_CHARS):
            if len(b):
                got = encode(b["text"].tolist(), vocabulary)
                doc_ids.append(b["doc_id"].fillna(NULL_ID).to_numpy(np.int64) if b["doc_id"].isna().any() else b["doc_id"].to_numpy(np.int64))
                counts.append(got[1])
                ids.append(got[0])
                held += len(got[0])
                if held >= shard_ids:
                    yield flush()
                    doc_ids, counts, ids, held, k = [], [], [], 0, k + 1
        if doc_ids:
            yield flush()

    ordered = rows.repartitionByRange(int(parts), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return ordered.select("doc_id", "text").mapInPandas(write, "part int, k int, file string, n_ids long")


def with_base(files: DataFrame) -> DataFrame:
    """files (part, k, n_ids) with base, the ids in all files before."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = F.floor(F.col("part") / GROUP).alias("g")
    parts = files.groupBy(group, "part").agg(F.sum("n_ids").alias("n_ids"))
    groups = parts.groupBy("g").agg(F.sum("n_ids").alias("n_ids")).select("g", before(Window.orderBy("g")).alias("of_groups"))
    parts = parts.select("g", "part", before(Window.partitionBy("g").orderBy("part")).alias("of_parts")).join(groups, "g").drop("g")
    own = files.withColumn("of_files", before(Window.partitionBy("part").orderBy("k")))
    return own.join(parts, "part").withColumn("base", F.col("of_groups") + F.col("of_parts") + F.col("of_files")).drop("of_groups", "of_parts", "of_files")


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in files (file, base) of folder; start counts from base on."""
    workers_find_package(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b["file"], b["base"], strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    doc_ids, ends, ids = decode_shard(f.read())
                at = np.concatenate(([0], ends)).astype(np.int64)
                flat = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array([None if x == NULL_ID else x for x in doc_ids.tolist()], "Int64"),
                    "start": base + at[:-1],
                    "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                })

    return files.select("file", "base").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, **sizes: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were written."""
    folder = shared_dir(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    files = scratch.stored(write_shards(docs, folder, vocabulary, **sizes))  # this is the job that writes
    tasks = max(1, min(files.count(), READ_TASKS))
    return read_shards(with_base(files).repartition(tasks), folder)  # a number, so tiny rows of large files are not put together


def op6_token_blocks(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
