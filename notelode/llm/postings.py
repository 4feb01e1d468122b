"""Approximate nearest neighbours by inner product over balanced posting lists.

Fit: a sample of about ``sample`` vectors is halved again and again by 2-means whose smaller side has a third at least, so
lists come out balanced; their means are the centroids (at most 3 * sample / leaf: raise the sample with the table), and each is
linked to its nearest ones. Vectors are divided by the largest norm, and inner products become distances by one more
component, sqrt(1 - |v|^2), with queries scaled to 1.

Index: every vector goes to its nearest centroid's list, and, if it lies at a boundary (another centroid is at most ``REPLICA``
times as far, and ``APART`` from the lists it has), to that list too. Search: the graph of centroids is walked in
memory from a few entries; a list is read if its centroid is at most ``ratio`` times as far as the nearest one (which counts
as far as that of a median query at least, or a query within a knot of near copies would see the knot alone). The ratio is
learned on the sample: with it, lists hold the share ``recall`` of true neighbours of sampled queries. There is no cap on
lists or candidates; a query also reads the list of its own vector,
where its copies are, and further lists until k + 1 vectors are there.

Tasks hold a part of neighbouring lists (``PART`` vectors, about) and a block of the queries that want them (``BLOCK``, about),
however large a list or its demand. Equal vectors are one, with its k + 1 smallest vec_ids: no more can be in a result, as ties
go to smaller ids. Only the sample (its bound is a parameter) and counts of lists reach the driver.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id or vectors of
another length than the most frequent (ties: the shortest). Rows of one vec_id are one, with its smallest vector. An empty
table gives an empty result. Extra columns are ignored; texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.llm.base import Scratch, table, workers_find_package

#: Vectors that are fitted, about; vectors of the sample a list, at most; queries that learn the ratio.
SAMPLE, LEAF, LEARN = 16_384, 48, 256
#: Share of true neighbours whose lists are read; how much further a replica's centroid may be; how far the walk looks.
RECALL, REPLICA, WALK = 0.97, 1.03, 1.08
#: Another list is of use if its centroid is that far from those of the lists a vector has, as a share of its distance.
APART = 0.6
LINKS, ENTRIES = 24, 32
#: Vectors and queries a task, about.
PART, BLOCK = 4096, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, key (two hashes of the vector): a row for each vec_id that takes part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.agg(F.max_by("n", F.struct("rows", -F.col("n"))).alias("n")).first()["n"]
    rows = rows.where(F.size("embedding") == F.lit(most)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.withColumn("key", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")))


def halved(v: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows of v in lists of at most leaf, near lists next to each other."""
    todo, out, rng = [np.arange(len(v))], [], np.random.default_rng(11)
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        x, least = v[own], len(own) // 3
        c = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            lean = x @ (c[1] - c[0])  # small: near the first
            order = np.argsort(lean, kind="stable")
            cut = int(np.clip((lean < (c[1] @ c[1] - c[0] @ c[0]) / 2).sum(), least, len(own) - least))
            c = np.stack([x[order[:cut]].mean(0), x[order[cut:]].mean(0)])
        todo += [own[order[cut:]], own[order[:cut]]]
    return out


class Lists:
    """The centroids, the graph that links them, and how far a query looks."""

    def __init__(self, sample: np.ndarray, norm: float, leaf: int = LEAF):
        self.norm, self.ratio, self.least = norm, 1.0, 0.0
        points = self.raised(sample)
        self.centroids = np.stack([points[own].mean(0) for own in halved(points, leaf)])
        n = len(self.centroids)
        self.graph = np.empty((n, min(LINKS, n)), np.int32)
        for k in range(n):
            self.graph[k] = self.linked(k, self.graph.shape[1])
        self.entries = np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)
        self.short, self.squares = self.centroids.astype(np.float32), (self.centroids**2).sum(1)

    def linked(self, k: int, links: int) -> list[int]:
        """Neighbours of a centroid: half of them in different directions (none is nearer to one before it), then the nearest."""
        far = self.apart(self.centroids[k : k + 1], self.centroids)[0]
        near = np.argsort(far, kind="stable")[: 8 * links]
        between, own = self.apart(self.centroids[near], self.centroids[near]), [0]
        for i in range(1, len(near)):
            if len(own) <= links // 2 and (between[i, own] >= far[near[i]]).all():
                own.append(i)
        return near[[*own, *[i for i in range(len(near)) if i not in own]][:links]].tolist()

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)

    def raised(self, v: np.ndarray) -> np.ndarray:
        """Vectors, scaled, with the component that makes all norms 1."""
        v = v / self.norm
        return np.hstack([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(1)))[:, None]])

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries, scaled to 1, in the space of raised vectors."""
        return np.hstack([q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None], np.zeros((len(q), 1))])

    def walk(self, points: np.ndarray, ratio: float, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances of points to the centroids that the walk meets (others: infinite), and each one's limit."""
        n, c = len(points), len(self.centroids)
        short, squares = points.astype(np.float32), (points * points).sum(1)
        dist, done = np.full((n, c), np.inf), np.zeros((n, c), bool)
        dist[:, self.entries] = np.sqrt(self.apart(points, self.centroids[self.entries]))
        while True:
            limit = ratio * np.maximum(least, best := dist.min(1))
            row, node = np.nonzero((dist <= np.maximum(limit, WALK * best)[:, None]) & ~done)
            if not len(row):
                return dist, limit
            done[row, node] = True
            met = np.zeros((n, c), bool)
            met[row[:, None], self.graph[node]] = True
            row, node = np.nonzero(met & np.isinf(dist))
            for k in range(0, len(row), 1 << 15):
                r, g = row[k : k + (1 << 15)], node[k : k + (1 << 15)]
                far = squares[r] + self.squares[g] - 2 * np.einsum("ij,ij->i", short[r], self.short[g])
                close = np.flatnonzero(far < 1e-2)  # too near for single precision
                far[close] = ((points[r[close]] - self.centroids[g[close]]) ** 2).sum(1)
                dist[r, g] = np.sqrt(far)

    def homes(self, v: np.ndarray) -> list[list[int]]:
        """The lists of each vector, its nearest first."""
        points, out = self.raised(v), []
        for k in range(0, len(v), 256):
            dist, limit = self.walk(points[k : k + 256], REPLICA)
            for row, most in zip(dist, limit, strict=True):
                near = np.flatnonzero(row <= most)
                near = near[np.argsort(row[near], kind="stable")]
                own = [int(near[0])]
                for c in near[1:].tolist():  # a boundary, in another direction than the lists it has
                    if all(((self.centroids[c] - self.centroids[x]) ** 2).sum() > (APART * row[c]) ** 2 for x in own):
                        own.append(c)
                out.append(own)
        return out

    def learn(self, sample: np.ndarray, k: int, recall: float) -> None:
        """The ratio that reaches the recall on queries drawn from the sample."""
        step = max(1, len(sample) // LEARN)
        own = np.arange(0, len(sample), step)
        far = np.sqrt(self.apart(self.asked(sample[own]), self.centroids))
        self.least, need = float(np.median(far.min(1))), [np.ones(1)]
        sims = sample[own] @ sample.T
        sims[np.arange(len(own)), own] = -np.inf
        top = np.argpartition(-sims, min(k, len(sample) - 1), axis=1)[:, :k]
        homes = dict(zip(flat := np.unique(top).tolist(), self.homes(sample[flat]), strict=True))
        for row, near in zip(far, top, strict=True):
            need.append(np.array([row[homes[x]].min() for x in near.tolist()]) / max(row.min(), self.least, 1e-300))
        self.ratio = float(np.quantile(np.concatenate(need), recall)) * 1.005 + 1e-9

    def wanted(self, q: np.ndarray, counts: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query reads, its own vector's first list among them: copies of it are there. counts: vectors that
        each list has as the nearest."""
        points, out, homes = self.asked(q), [], self.homes(q)
        for k in range(0, len(q), 256):
            dist, limit = self.walk(points[k : k + 256], self.ratio, self.least)
            for point, row, most, home in zip(points[k : k + 256], dist, limit, homes[k : k + 256], strict=True):
                own = np.union1d(np.flatnonzero(row <= most), home[:1]).astype(np.int64)
                if counts[own].sum() < least:
                    order = np.argsort(self.apart(point[None], self.centroids)[0], kind="stable")
                    own = np.union1d(own, order[: int(np.searchsorted(np.cumsum(counts[order]), least)) + 1])
                out.append(own)
        return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fit(rows: DataFrame, k: int, sample: int, recall: float, leaf: int = LEAF) -> Lists | None:
    """Lists from a sample of different vectors, by their hashes; None if there are no rows."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, norm = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    if not n:
        return None
    share = min(1.0, sample / n)
    got = rows.where(F.pmod(F.col("key.a"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    v = got.select("key", "embedding").toPandas()
    v = v.iloc[np.argsort([x["a"] for x in v["key"]], kind="stable")] if len(v) else rows.select("embedding").limit(1).toPandas()
    v = stacked(v["embedding"])
    lists = Lists(v, norm, leaf)
    lists.learn(v, k, recall)
    return lists


def posted(rows: DataFrame, lists) -> DataFrame:
    """key, embedding, ids, list, own (it is the nearest): a row for each list of each vector."""
    plain = rows.select("key.a", "key.b", "embedding", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                homes = lists.value.homes(stacked(b["embedding"]))
                out = b.iloc[np.repeat(np.arange(len(b)), [len(x) for x in homes])].reset_index(drop=True)
                out["list"] = [c for own in homes for c in own]
                out["own"] = [not k for own in homes for k in range(len(own))]
                yield out

    return plain.mapInPandas(run, f"a long, b long, embedding {plain.schema['embedding'].dataType.simpleString()}, ids array<long>, list int, own boolean")


def aimed(queries: DataFrame, lists, counts: np.ndarray, group: np.ndarray, least: int) -> DataFrame:
    """a, b, embedding, grp, wants (lists of the group): a row for each group of lists that a query reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            at, grp, wants = [], [], []
            for i, own in enumerate(lists.value.wanted(stacked(b["embedding"]), counts, least)):
                for g in np.unique(group[own]).tolist():
                    at.append(i)
                    grp.append(g)
                    wants.append(own[group[own] == g].tolist())
            out = b.iloc[at].reset_index(drop=True)
            out["grp"], out["wants"] = grp, wants
            yield out

    return queries.mapInPandas(run, f"a long, b long, embedding {queries.schema['embedding'].dataType.simpleString()}, grp int, wants array<int>")


def best(k: int):
    """Of one block of queries and one part of lists: the k vectors of greatest inner product, summed exactly."""

    def run(_, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            vector = v.groupby(["a", "b"], sort=False).ngroup().to_numpy()
            place, names = pd.factorize(v["list"])
            member = np.zeros((len(names), vector.max() + 1), np.float32)
            member[place, vector] = 1
            one = v.drop_duplicates(["a", "b"])
            x, ids = stacked(one["embedding"]), one["ids"].tolist()
            lowest = np.array([i[0] for i in ids])
            number = {c: i for i, c in enumerate(names.tolist())}
            asked = stacked(q["embedding"])
            slack = 1e-12 * np.sqrt((x * x).sum(1).max())
            for at in range(0, len(q), 256):
                part = asked[at : at + 256]
                want = np.zeros((len(part), len(names)), np.float32)
                for i, own in enumerate(q["wants"].iloc[at : at + 256]):
                    want[i, [number[c] for c in own if c in number]] = 1
                sims = np.where(want @ member > 0, part @ x.T, -np.inf)
                kth = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(part), -np.inf)
                bound = kth - slack * np.sqrt((part * part).sum(1))
                for i in range(len(part)):
                    near = np.flatnonzero((sims[i] >= bound[i]) & (sims[i] > -np.inf))
                    exact = np.array([math.fsum(r) for r in (x[near] * part[i]).tolist()])
                    order = np.lexsort((lowest[near], -exact))[:k]
                    a, b = q["a"].iloc[at + i], q["b"].iloc[at + i]
                    out += [(a, b, s, lo, ids[j]) for s, lo, j in zip(exact[order].tolist(), lowest[near[order]].tolist(), near[order].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "score", "lowest", "ids"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, part: int = PART, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every, but for itself."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark)
    rows = scratch.stored(usable(vectors))
    # equal vectors: the k + 1 smallest ids, cut before they meet
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    groups = scratch.stored(first.groupBy("key").agg(F.min("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    lists = fit(groups, k, sample, recall, leaf)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(lists)
    index = scratch.stored(posted(groups, held))
    scratch.drop(groups)
    n = len(lists.centroids)
    size, own = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect():  # at most n rows
        size[r["list"]], own[r["list"]] = r["n"], r["own"]
    group, parts, filled = np.zeros(n, np.int32), [], part
    for c in range(n):  # neighbouring lists together; a large list alone
        if not parts or filled + size[c] > part:
            parts.append(0)
            filled = 0
        filled += size[c]
        parts[-1] = max(1, math.ceil(filled / part))
        group[c] = len(parts) - 1
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.groupBy("key").agg(F.min("embedding").alias("embedding")).select("key.a", "key.b", "embedding")
    asked = scratch.stored(aimed(asked, held, own, group, k + 1))
    blocks = [1] * len(parts)
    for r in asked.groupBy("grp").agg(F.count("*").alias("n")).collect():  # at most n rows
        blocks[r["grp"]] = math.ceil(r["n"] / block)
    of = lambda values, at: F.element_at(F.array(*[F.lit(int(x)) for x in values]), at + 1)
    dealt = lambda count: F.pmod(F.xxhash64("a", "b", F.lit(7)), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    v = index.withColumn("grp", of(group, F.col("list"))).withColumn("part", dealt(of(parts, F.col("grp")))).withColumn("block", each(of(blocks, F.col("grp"))))
    q = asked.withColumn("block", dealt(of(blocks, F.col("grp")))).withColumn("part", each(of(parts, F.col("grp"))))
    met = q.groupBy("grp", "part", "block").cogroup(v.groupBy("grp", "part", "block")).applyInPandas(best(k + 1), "a long, b long, score double, lowest long, ids array<long>")
    # a vector of two lists may come twice, with one rank
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "lowest")
    top = met.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("vec_id")))
    top = top.groupBy("a", "b").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k + 1).alias("near"))
    own = queries.select(F.col("vec_id").alias("query_id"), "key.a", "key.b").join(top, ["a", "b"])
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(near).alias("r", "x"))
    return out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op11_posting_lists(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
