"""SentencePiece encoding and decoding, with segmentations sampled by forward filtering and backward sampling.

The lattice of a text has an arc for every vocabulary piece that matches at a position; a character without a piece has an
arc of its byte pieces. An arc's weight comes from the model: a unigram model's log probabilities as they are; a merge
model's rank r as log(1 / (r + 1)). ``alpha`` sharpens (above 1) or flattens the law. Filtering sums the weights of all
paths to each position; sampling walks back from the end and draws each arc by its share of the sum. Draws come from the
seed, the row key and the position, so a row's segmentation does not depend on batch, partition or run.

Pieces never run from a word into the space after it, so a text's lattice is the chain of the lattices of its words, each
with the space before it; each different word of a batch is filtered once, and both filtering and draws take one step
for all words of the batch at a time.

As in SentencePiece, one space is put before the text and spaces become U+2581; that character itself, like any without
a piece, is spelled in byte pieces, so decoding gives back the very text. Null texts give no ids (null decodes from them as
the empty text), empty texts give none either. Repeated rows are segmented alike. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from notelode.llm.base import DOC_COLUMNS, table, workers_find_package

ALPHA = 1.0
SEED = 29
SPACE = "\u2581"
#: Stands for U+2581 in a text; a lone surrogate, which no text that Spark reads can hold.
MARK = "\udc81"
#: Stands between words, as unknown to texts and pieces.
GAP_MARK = "\udc80"
#: Batches are cut into parts of about so many characters: a part's lattice takes some hundred bytes for each.
PART_CHARS = 1 << 18
_worker: dict = {}


class Lattice:
    """The pieces of a model, their weights and the lattices that they span."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        scores = [sp.get_score(i) for i in range(n)]
        merges = all(float(scores[i]).is_integer() for i in plain)
        top = max(scores[i] for i in plain)
        self.weight = [(-math.log(max(0.0, top - x) + 1) if merges else x) * alpha for x in scores]
        self.lowest = min(self.weight[i] for i in plain)
        self.grow_tries({self.pieces[i]: i for i in plain if SPACE not in self.pieces[i].lstrip(SPACE)})
        self.spelled = [b"" if special[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.weight = np.array(self.weight)

    def grow_tries(self, pieces: dict[str, int]) -> None:
        """single: the piece of each character alone, or -1. Longer pieces: a trie over their characters from the last
        to the first, as a table from node and character class to node (0: none), and the piece that a node ends."""
        self.single = np.full(0x110000, -1, np.int32)
        longer = {}
        for x, i in pieces.items():
            if len(x) == 1:
                self.single[ord(x)] = i
            else:
                longer[x[::-1]] = i
        letters = {c: k for k, c in enumerate(sorted({c for x in longer for c in x}), 1)}
        self.kind = np.zeros(0x110000, np.int32)
        for c, k in letters.items():
            self.kind[ord(c)] = k
        self.kinds = len(letters) + 1
        nodes: dict[str, int] = {"": 1}
        edges, ends = [], {}
        for x, i in longer.items():
            for k in range(1, len(x) + 1):
                if x[:k] not in nodes:
                    nodes[x[:k]] = len(nodes) + 1
                    edges.append(nodes[x[: k - 1]] * self.kinds + letters[x[k - 1]])
            ends[nodes[x]] = i
        self.next = np.zeros((len(nodes) + 1) * self.kinds, np.int32)
        self.next[edges] = np.arange(2, len(nodes) + 1)
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def matches(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and piece of every match in joined, by end; a character without a piece has -1 - character."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = self.kind[code]
        own = self.single[code].astype(np.int64)
        bare = np.where(code == ord(MARK), ord(SPACE), code)
        end = np.arange(1, len(code) + 1)
        inside = code != ord(GAP_MARK)
        found = [(end[inside], np.where(own < 0, -1 - bare, own)[inside], 1)]
        at = self.next[self.kinds + kind]
        size = 1
        while True:
            live = at > 0
            live[end <= size] = False
            end, at = end[live], at[live]
            if not len(end):
                break
            size += 1
            at = self.next[at * np.int64(self.kinds) + kind[end - size]]
            piece = self.ends[at]
            hit = np.flatnonzero(piece >= 0)
            found.append((end[hit], piece[hit].astype(np.int64), size))
        count = np.zeros(len(code) + 2, np.int64)
        for e, _, _ in found:
            count[e + 1] += 1
        place = np.cumsum(count)
        total = int(place[-1])
        start, stop, pieces = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for e, i, size in found:
            to = place[e]
            start[to], stop[to], pieces[to] = e - size, e, i
            place[e] += 1
        return start, stop, pieces

    def filtered(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of all words at once, filtered from their starts, position by position.

        Nodes are the places between characters: a word at offset b of the joined words has the nodes b to b + length.
        Returns each word's last node, each node's place in its word, and of the arcs in order of the node that they
        enter: (node << 32 | share of the node's sum up to this arc, of 1 << 31), the node they leave, the piece.
        """
        joined = GAP_MARK.join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(lengths + 1) - lengths - 1
        place = np.arange(len(joined) + 1) - np.repeat(base, lengths + 1)
        start, end, piece = self.matches(joined)
        weight = np.where(piece < 0, self.lowest, self.weight[piece])
        level = place[end]
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(1, level.max(initial=0) + 2))
        log_sum = np.zeros(len(joined) + 1)
        share = np.zeros(len(end), np.int64)
        for lo, hi in pairwise(bounds.tolist()):
            own = order[lo:hi]
            node = end[own]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            count = np.diff(np.append(first, hi - lo))
            logs = log_sum[start[own]] + weight[own]
            top = np.maximum.reduceat(logs, first)
            part = np.exp(logs - np.repeat(top, count))
            total = np.add.reduceat(part, first)
            log_sum[node[first]] = top + np.log(total)
            run = np.cumsum(np.rint(part / np.repeat(total, count) * (1 << 31)).astype(np.int64))
            run -= np.repeat(np.append(0, run[first[1:] - 1]), count)
            run = np.minimum(run, 1 << 31)
            run[first + count - 1] = 1 << 31
            share[own] = run
        return base + lengths, place, end << 32 | share, start, piece

    def sample(self, texts: list[str], rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids. rows: a 64-bit key of each."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                text = text.replace(SPACE, MARK)
                if "  " in text or text[0] == " " or text[-1] == " ":
                    own = split_runs(text)
                else:
                    own = [SPACE + x for x in text.split(" ")]
                words += own
                counts[k] = len(own)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint32), counts
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        last, place, keys, source, piece = self.filtered(list(index))
        node = last[np.fromiter(map(index.__getitem__, words), np.int64, n)]
        text_of = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        stream = mixed(mixed(rows.astype(np.uint64)[text_of] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + at.astype(np.uint64))
        live = np.arange(n)
        steps = np.zeros(n, np.int64)
        drawn = []
        while len(live):
            u = mixed(stream[live] + place[node].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(33)
            arc = np.searchsorted(keys, node << 32 | u.astype(np.int64), side="right")
            drawn.append((live, piece[arc]))
            steps[live] += 1
            node = source[arc]
            more = place[node] > 0
            live, node = live[more], node[more]
        ends = np.cumsum(steps)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - k] = ids
        return self.with_bytes(out, np.bincount(text_of, weights=steps, minlength=len(texts)).astype(np.int64))

    def with_bytes(self, ids: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, kept as -1 - character so far, become byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.uint32), number
        spelled = {int(c): [self.byte[b] for b in chr(-1 - int(c)).encode("utf-8", "surrogatepass")] for c in np.unique(ids[odd])}
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(spelled[c]) for c in ids[odd].tolist()]
        starts = np.cumsum(times) - times
        out = np.repeat(ids, times)
        for s, c in zip(starts[odd].tolist(), ids[odd].tolist(), strict=True):
            out[s : s + len(spelled[c])] = spelled[c]
        text = np.repeat(np.arange(len(number)), number)
        return out.astype(np.uint32), np.bincount(text, weights=times, minlength=len(number)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")  # without the space that was put before the text


def split_runs(text: str) -> list[str]:
    """The words of text with one more space before it, each with the run of spaces before it as U+2581."""
    out, run = [], 0
    for x in text.split(" "):
        run += 1
        if x:
            out.append(SPACE * run + x)
            run = 0
    return [*out, SPACE * run] if run else out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lattice(model: str, alpha: float) -> Lattice:
    if _worker.get("of") != (model, alpha):
        _worker.update(of=(model, alpha), lattice=Lattice(model, alpha))
    return _worker["lattice"]


def arrow_parts(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about so many characters of text; a slice is a view, not a copy."""
    for b in batches:
        sizes = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // chars
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in pairwise(bounds) if y > x)


def encode(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED, digest: bool = False) -> DataFrame:
    """The columns of docs, ids (array of int), lossless: a row for each row of docs. Columns of docs that have these two
    names are replaced.

    With digest: doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_bytes and
    decoded_sha256 (of the text decoded from the ids), lossless instead.
    """
    workers_find_package(docs.sparkSession)
    docs = docs.select("doc_id", "text") if digest else docs.select(*[c for c in docs.columns if c not in ("ids", "lossless")])
    fields = "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_sha256 string, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_lattice = lattice(model, alpha)
        for b in arrow_parts(batches, PART_CHARS):
            texts = [x or "" for x in b.column("text").to_pylist()]
            rows = pc.fill_null(b.column("doc_id"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, number = model_lattice.sample(texts, rows, seed)
            ends = np.cumsum(number)
            each = np.split(ids, ends[:-1])
            decoded = [model_lattice.decode(x) for x in each]
            lossless = pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_())
            if digest:
                raw = [x.encode("utf-8", "surrogatepass") for x in decoded]
                crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
                columns = {"doc_id": b.column("doc_id"), "n_ids": pa.array(number), "ids_crc32": crc, "n_bytes": pa.array(map(len, raw), pa.int64()), "decoded_sha256": sha, "lossless": lossless}
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"ids": lists, "lossless": lossless}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if digest:
        return docs.mapInArrow(run, fields)
    out = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())])
    return docs.mapInArrow(run, out)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with decoded: the text of each row's ids; null ids give null. A column decoded of rows is replaced."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        own = lattice(model, ALPHA)
        return column.map(lambda x: None if x is None else own.decode(np.asarray(x)))

    return rows.withColumn("decoded", text_of(F.col(ids)))


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark, sf_dir) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), _model(), digest=True)


def pieces_stage(spark, docs, sf_dir) -> DataFrame:
    """The documents with their ids: a row for each row, nulls and repeats included; an empty table gives an empty result.
    Extra columns are left out."""
    return encode(docs.select(*DOC_COLUMNS), _model())
