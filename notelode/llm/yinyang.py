"""Centroid clustering of integer vectors by Yinyang k-means, exactly.

Components x become floor(scale * x). Centroids start as the k vectors whose ids have the smallest hash, and are put into
groups once. A vector carries an upper bound of the distance to its own centroid and a lower bound for each group: that of
its other centroids. A round loosens the bounds by how far centroids moved. Where the upper bound is below all lower ones,
nothing is computed (global filter); else it is made exact, and only the centroids of groups whose bound it reaches are
scanned (group filter). Filters are strict, with slack for rounding, and scans are in integers: ties go to the smaller
number, exactly as a full scan would have it.

A round reads the stored state and writes the next; only the sums of vectors that changed their cluster are aggregated, as k
rows. What reaches the driver are k centroids and k sums. When no vector changes, centroids stay, so later rounds are left out.

Vectors that are null, of another length, or hold null or non-finite components take no part; nor do those with a component
beyond ``LARGEST``, whose squared distances a long may not hold. A null vec_id hashes as an empty one; of equal hashes
the smaller vector comes first. Repeated rows count as rows; with fewer than k vectors there are fewer centroids. An empty
table gives an empty result. Extra columns are ignored; texts are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import Scratch, table, workers_find_package

#: Largest component of a vector: 64 squares of twice its 1024-fold still fit a long.
LARGEST = float(1 << 17)
SLACK = 1e-9
#: Vectors that a worker takes up at a time.
ROWS = 4096


def integral(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, x (integers): the vectors that take part."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    whole = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to rows c, in whole numbers."""
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def grouped(c: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves."""
    middle = c[:groups].astype(np.float64)
    for _ in range(5):
        of = ((c[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.stack([c[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return np.unique(of, return_inverse=True)[1]


def nearest(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New own, upper and lower of vectors x, whose bounds hold for the centroids c; own is -1 at the start."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    open_ = np.flatnonzero(~(upper < lower.min(1)))  # global filter
    held = open_[own[open_] >= 0]
    upper[held] = np.sqrt(((x[held] - c[own[held]]) ** 2).sum(1))
    open_ = open_[~(upper[open_] * (1 + SLACK) < lower[open_].min(1))]
    if not len(open_):
        return own, upper, lower
    scan = ~(upper[open_, None] * (1 + SLACK) < lower[open_])  # group filter
    most = np.iinfo(np.int64).max
    dist = np.full((len(open_), len(c)), most)
    old = own[open_]
    for g in range(lower.shape[1]):
        at, of = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        dist[np.ix_(at, of)] = squares(x[open_[at]], c[of])
    held = np.flatnonzero(old >= 0)
    dist[held, old[held]] = ((x[open_[held]] - c[old[held]]) ** 2).sum(1)
    new = dist.argmin(1)  # the first of the smallest
    own[open_], upper[open_] = new, np.sqrt(dist[np.arange(len(new)), new])
    dist[np.arange(len(new)), new] = most
    for g in range(lower.shape[1]):
        rest = np.sqrt(dist[:, group == g].min(1).astype(np.float64)) * (1 - SLACK)
        left = (old >= 0) & (old != new) & (group[old] == g) & ~scan[:, g]  # the old centroid is now one of the others
        now = np.where(scan[:, g], rest, np.where(left, np.minimum(lower[open_, g], rest), lower[open_, g]))
        lower[open_, g] = now
    return own, upper, lower


def assigned(state: DataFrame, c: np.ndarray, group: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """The state after one more assignment; moved: how far each centroid went. With last, distance is exact, else null."""
    most = np.array([moved[group == g].max() for g in range(group.max() + 1)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                b = whole.iloc[k : k + ROWS].reset_index(drop=True)
                x = np.stack(b["x"].to_numpy()).astype(np.int64)
                was = b["cluster"].to_numpy(np.int64)
                upper = b["upper"].to_numpy(np.float64) * (1 + SLACK) + np.where(was >= 0, moved[was], 0.0)
                lower = np.maximum(0.0, np.stack(b["lower"].to_numpy()) * (1 - SLACK) - most)
                own, upper, lower = nearest(x, was, upper, lower, c, group)
                out = b[["vec_id", "x"]].copy()
                out["cluster"], out["was"], out["upper"], out["lower"] = own, was, upper, list(lower)
                out["distance"] = ((x - c[own]) ** 2).sum(1) if last else 0
                yield out.astype({"vec_id": "Int64"})

    return state.mapInPandas(run, "vec_id long, x array<int>, cluster int, was int, upper double, lower array<double>, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, groups: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark)
    rows = integral(vectors, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r["x"] for r in first], np.int64)
    group = grouped(c, min(groups, len(c)))
    start = [F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array(*[F.lit(0.0)] * int(group.max() + 1)).alias("lower")]
    state, moved = rows.select("vec_id", "x", *start), np.zeros(len(c))
    counts, sums = [0] * len(c), [[0] * dims for _ in c]
    for turn in range(rounds + 1):
        before, state = state, scratch.stored(assigned(state, c, group, moved, turn == rounds))
        scratch.drop(before)
        if turn == rounds:
            break
        ends = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign"))))
        change = state.where("cluster <> was").select("x", ends.alias("e")).where("e.c >= 0")
        change = change.groupBy("e.c").agg(F.sum("e.sign").alias("n"), *[F.sum(F.col("e.sign") * F.col("x")[i]).alias(f"s{i}") for i in range(dims)])
        old = c.copy()
        for r in change.collect():  # at most k rows
            counts[r["c"]] += r["n"]
            sums[r["c"]] = [s + r[f"s{i}"] for i, s in enumerate(sums[r["c"]])]
        for i, n in enumerate(counts):
            if n:
                c[i] = [s // n for s in sums[i]]
        moved = np.sqrt(((c - old) ** 2).sum(1)) * (1 + SLACK)
        if not moved.any():  # nothing can change any more
            before, state = state, scratch.stored(assigned(state, c, group, moved, True))
            scratch.drop(before)
            break
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return state.select(
        "vec_id", "cluster", "distance",
        of([inertia.get(i, 0) for i in range(len(c))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(names).alias("centroid_sha256"),
    )


def op12_yinyang(spark, sf_dir) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by a full scan of all centroids in each round."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(x) <= {LARGEST})) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
        "n AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, x FROM v)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT i, min((d, c)) AS best FROM (SELECT n.i, c.c, list_sum(list_transform(list_zip(n.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM n, c{r} AS c) GROUP BY i)"
        )
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN (SELECT c, list(((s - ((s % z) + z) % z) // z)::BIGINT ORDER BY j) AS x FROM "
                f"(SELECT a.best[2] AS c, j, sum(x[j]) AS s, count(*) AS z FROM n JOIN a{r} AS a USING (i), (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY 1, 2) GROUP BY c) AS m ON m.c = c.c)"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, "
        f"(sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM n JOIN a{rounds} AS a USING (i) JOIN c{rounds} AS c ON c.c = a.best[2]"
    )


SQL = _sql()
