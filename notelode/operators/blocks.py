"""All pairs of rows, met block by block.

Rows are packed into blocks of bounded size, in order of their sizes, and stored. Each block then meets each other one, and itself, in a
task that reads both from the shared folder: nothing is shuffled, no key is hot, and a task holds two blocks. Blocks that can't hold a
pair, by their least and greatest sizes, do not meet. The work grows with the square of the rows, at a few nanoseconds a pair
of rows; memory and disk grow with the rows and with the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.plans.checkpoints import stored, workers_find_package

#: Rows of a block, and values of their sets, at most (one larger set is a block).
ROWS, VALUES = 8192, 1 << 19
#: Meetings that are counted at a time, and cells of the table that counts them.
STEP, CELLS = 1 << 21, 1 << 22


def packed(rows: DataFrame, pack: Callable, schema: str, most: int = ROWS, weight: str | None = None) -> DataFrame:
    """rows (doc_id, n, ..., sorted by n; those without a doc_id are left out) as stored blocks: block (its least doc_id), lo, hi (of n), and
    the columns that pack makes of a pandas frame. weight: the column that counts against VALUES."""
    rows = rows.where("doc_id is not null")
    parts = max(1, -(-rows.count() // most))
    dealt = rows.repartitionByRange(parts, "n", "doc_id").sortWithinPartitions("n", "doc_id").coalesce(parts)
    of = lambda b: {"block": int(b["doc_id"].min()), "lo": int(b["n"].min()), "hi": int(b["n"].max())} | pack(b)
    return in_blocks(dealt, of, f"block long, lo int, hi int, {schema}", most, weight, VALUES)


def in_blocks(rows: DataFrame, pack: Callable, schema: str, most: int, weight: str | None = None, values: int = VALUES) -> DataFrame:
    """The rows of each task in stored blocks of at most so many rows, and values by the column weight (one larger row is a block)."""
    workers_find_package(rows.sparkSession)

    def run(batches):
        import pandas as pd

        def block(held):
            return pd.DataFrame([pack(pd.concat(held, ignore_index=True))])

        held, size, load = [], 0, 0
        for b in batches:
            at = 0
            loads = b[weight].to_numpy() if weight else None
            for k in range(len(b)):
                more = int(loads[k]) if weight else 0
                if size and (size >= most or load + more > values):
                    yield block([*held, b.iloc[at:k]])
                    held, size, load, at = [], 0, 0, k
                size, load = size + 1, load + more
            if at < len(b):
                held.append(b.iloc[at:])
        if size:
            yield block(held)

    return stored(rows.mapInPandas(run, schema))


def met(blocks: DataFrame, run: Callable, schema: str, possible) -> DataFrame:
    """What run yields (pandas frames) for each two blocks, given as dicts a and b: the same one twice, if a["block"] == b["block"].
    possible: a condition on the columns of both, ending in _a and _b."""
    return crossed(blocks, blocks, run, schema, (F.col("block_a") <= F.col("block_b")) & possible)


def crossed(left: DataFrame, right: DataFrame, run: Callable, schema: str, possible=None) -> DataFrame:
    """What run yields for each block of left (as a dict a) with each of right (b)."""
    side = lambda df, k: df.select(*[F.col(c).alias(f"{c}_{k}") for c in df.columns])
    # read, not shuffled or broadcast: each task reads its own blocks
    both = side(left, "a").join(side(right, "b").hint("shuffle_replicate_nl"), F.lit(True) if possible is None else possible)

    def each(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                a, b = ({c[:-2]: v for c, v in row.items() if c.endswith(f"_{k}")} for k in "ab")
                yield from run(a, b)

    return both.mapInPandas(each, schema)


def _spread(starts, lengths):
    """The places of runs that begin at starts and have these lengths."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _sets(b):
    """Sets of whole numbers by their different values: each value's rows."""
    import numpy as np

    rows = np.repeat(np.arange(len(b)), [len(x) for x in b["names"]])
    values = np.concatenate([np.asarray(x, np.int64) for x in b["names"]])
    order = np.argsort(values, kind="stable")
    known, starts = np.unique(values[order], return_index=True)
    take = lambda x, kind: np.asarray(x).astype(kind).tobytes()
    return {"need": int(b["need"].min()), "ids": take(b["doc_id"], np.int64), "sizes": take(b["n"], np.int32), "needs": take(b["need"], np.int32), "known": known.tobytes(), "starts": take([*starts, len(values)], np.int32), "rows": take(rows[order], np.int32)}


def counted(a, b, same: bool, least: int = 1):
    """Chunks of (row of a, row of b, values that they share), of rows that share so many; a and b: known, starts, rows, and their numbers
    of rows. same: a is b, and each pair is wanted once."""
    import numpy as np

    (known_a, starts_a, rows_a, _), (known_b, starts_b, rows_b, width) = a, b
    if not len(known_a) or not len(known_b):
        return
    at = np.minimum(np.searchsorted(known_b, known_a), len(known_b) - 1)
    ia = np.flatnonzero(known_b[at] == known_a)
    ib, la = at[ia], (starts_a[ia + 1] - starts_a[ia]).astype(np.int64)
    row, value = rows_a[_spread(starts_a[ia].astype(np.int64), la)], np.repeat(ib, la)
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    first, length = starts_b[value].astype(np.int64), (starts_b[value + 1] - starts_b[value]).astype(np.int64)
    load, begins = np.cumsum(length), np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
    ends = np.r_[begins[1:], len(row)] if len(row) else []
    k = 0
    while k < len(begins):
        lo, base = begins[k], load[begins[k]] - length[begins[k]]
        upto = max(k + 1, min(int(np.searchsorted(load[ends - 1], base + STEP, side="right")), int(np.searchsorted(row[begins], row[lo] + max(1, CELLS // width)))))
        hi = ends[upto - 1]
        from_row = int(row[lo])
        cell = np.repeat((row[lo:hi].astype(np.int64) - from_row) * width, length[lo:hi]) + rows_b[_spread(first[lo:hi], length[lo:hi])]
        counts = np.bincount(cell)
        found = np.flatnonzero(counts >= max(1, least))
        shared, (x, y) = counts[found], np.divmod(found, width)
        x = x + from_row
        if same:
            x, y, shared = (v[x < y] for v in (x, y, shared))
        yield x, y, shared
        k = upto


def sharing_enough(sets: DataFrame) -> DataFrame:
    """doc_a < doc_b, shared, n_a, n_b: the pairs of sets (doc_id, n, need, names: different 64-bit numbers, n of them) that share as many
    as either needs."""
    blocks = packed(sets, _sets, "need int, ids binary, sizes binary, needs binary, known binary, starts binary, rows binary", weight="n")

    def run(a, b):
        import numpy as np
        import pandas as pd

        (ids_a, n_a, need_a, *set_a), (ids_b, n_b, need_b, *set_b) = ([np.frombuffer(s[c], np.int64 if c in ("ids", "known") else np.int32) for c in ("ids", "sizes", "needs", "known", "starts", "rows")] for s in (a, b))
        for x, y, shared in counted((*set_a, len(ids_a)), (*set_b, len(ids_b)), a["block"] == b["block"], max(a["need"], b["need"])):
            enough = shared >= np.maximum(need_a[x], need_b[y])
            x, y, shared = x[enough], y[enough], shared[enough]
            turn = ids_a[x] > ids_b[y]
            for at in range(0, len(x), 1 << 16):
                i, j, s, t = (v[at : at + (1 << 16)] for v in (x, y, shared, turn))
                p, q, m, n = ids_a[i], ids_b[j], n_a[i], n_b[j]
                yield pd.DataFrame({"doc_a": np.where(t, q, p), "doc_b": np.where(t, p, q), "shared": s, "n_a": np.where(t, n, m), "n_b": np.where(t, m, n)})

    return met(blocks, run, "doc_a long, doc_b long, shared long, n_a int, n_b int", F.least("hi_a", "hi_b") >= F.greatest("need_a", "need_b"))
