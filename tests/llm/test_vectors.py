"""Nearest neighbours, clustering and importance resampling against brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from notelode.llm import importance, postings, yinyang

SF = "/root/testdata/sf0.001"
#: Extra columns with the names of inner ones.
EXTRA = "key string, x string, cluster string, list string, part string, ids string, r string"
ODD = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (None, [1.0] * 64), (8, [1.0] * 3)]


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, *"abcdefg") for i, v in rows], f"vec_id long, embedding array<{kind}>, {EXTRA}")


def made(n, seed=0, dims=64):
    """Weak clusters, a third of all rows copies of one vector and a fifth near copies of another, of unlike norms."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] * 0.5 + rng.normal(size=(n, dims))
    v *= rng.uniform(0.5, 2, n)[:, None]
    v[: n // 3] = v[0]
    v[n // 3 : n // 3 + n // 5] = v[n // 3] + rng.normal(size=(n // 5, dims)) * 0.01
    ids = rng.permutation(n)
    return [(int(i), x.astype(np.float32).astype(float).tolist()) for i, x in zip(ids, v, strict=True)]


def brute(rows, every, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % every == 0:
            s = [math.fsum(r) for r in (v * q).tolist()]
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -np.array(s))) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_postings_recall_order_and_scores(spark):
    rows = made(3000)
    want, got = brute(rows, 20, 20), found(postings.search(table(spark, [*rows, *ODD]), sample=1000, part=256, block=32))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    every = brute(rows, 20, 3000)
    score = {q: dict(every[q]) for q in list(want)[:40]}
    for q, near in list(got.items()):
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in dict(near)
        assert all(score[q][i] == s for i, s in near) if q in score else True
    hits = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    copies = {i for i, x in rows if x == rows[0][1]}
    for q in copies & set(got):  # exact: all copies are one, with its smallest ids
        assert got[q] == want[q]


def test_postings_recall_on_the_tables(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows, 20, 20), found(postings.op11_posting_lists(spark, SF))
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) / (20 * len(want)) >= 0.95


def test_postings_small_repeated_and_empty(spark):
    rows = [(20 * i, [float(i % 3), 1.0]) for i in range(12)]
    want = brute(rows, 20, 20)
    assert found(postings.search(table(spark, [*rows, *rows, *[(i, v) for i, v in ODD if i != 8]]))) == want and all(len(x) == 11 for x in want.values())
    assert found(postings.search(table(spark, [*rows, (0, [9.0, 9.0])]))) == want  # of one vec_id, the smallest vector
    assert postings.search(table(spark, ODD[:7], "double").where("vec_id < 8")).count() == 0
    assert postings.search(table(spark, [])).count() == 0
    alone = postings.search(table(spark, [(0, [1.0, 2.0])]))
    assert alone.columns == ["query_id", "rank", "vec_id", "score"] and alone.count() == 0


def test_lists_are_balanced_and_walks_find_all():
    v = np.unique(np.array([x for _, x in made(4000, dims=8)]), axis=0)
    lists = postings.Lists(v, float(np.sqrt((v * v).sum(1).max())))
    assert all(len(own) <= postings.LEAF for own in postings.halved(v, postings.LEAF)) and min(len(own) for own in postings.halved(v, postings.LEAF)) >= postings.LEAF // 3
    points = lists.raised(v[::7])
    dist, limit = lists.walk(points, 1.3)
    exact = np.sqrt(lists.apart(points, lists.centroids))
    near = exact <= 1.3 * exact.min(1)[:, None]
    assert (dist[near] < np.inf).mean() >= 0.99 and np.isclose(limit, 1.3 * exact.min(1), rtol=1e-4).mean() >= 0.95
    assert any(len(x) > 1 for x in lists.homes(v[::7]))  # boundary vectors are in several lists


def full_scan(x, ids, k, rounds, seed):
    first = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i]))[:k]
    x = np.array(x, np.int64)
    c = x[first].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if turn < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = [s // int((own == j).sum()) for s in x[own == j].sum(0).tolist()]
    return own, d.min(1), c


@pytest.mark.parametrize("n,k,groups,seed", [(600, 8, 3, 0), (600, 12, 4, 1), (5, 8, 3, 2), (300, 1, 3, 3)])
def test_yinyang_equals_full_scan(spark, n, k, groups, seed):
    rows = made(n, seed)
    rows += [(None, rows[0][1]), rows[1], rows[1]]
    got = yinyang.cluster(table(spark, [*rows, *[x for x in ODD if x[0] != 3], (-9, [3e38] * 64)]), k=k, groups=groups).collect()
    rows += [(None, [1.0] * 64)]
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    own, dist, c = full_scan(x, [i for i, _ in rows], k, 10, 3)
    names = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    inertia = Counter()
    for o, d in zip(own.tolist(), dist.tolist(), strict=True):
        inertia[o] += d
    want = [(i, o, d, inertia[o], sum(inertia.values()), names[o]) for (i, _), o, d in zip(rows, own.tolist(), dist.tolist(), strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_yinyang_ties_zero_and_empty(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)] + [(100, [0.5] * 64), (101, [0.5] * 64), (3, [0.0] * 64)]
    got = sorted(str((r.vec_id, r.cluster, r.distance)) for r in yinyang.cluster(table(spark, rows), k=2).collect())
    own, dist, _ = full_scan([[math.floor(1024 * c) for c in v] for _, v in rows], [i for i, _ in rows], 2, 10, 3)
    assert got == sorted(str((i, o, d)) for (i, _), o, d in zip(rows, own.tolist(), dist.tolist(), strict=True))
    assert yinyang.cluster(table(spark, [])).count() == 0 and yinyang.cluster(table(spark, ODD[:2])).count() == 0


def test_yinyang_bounds_skip_work():
    rng = np.random.default_rng(4)
    c = rng.integers(-500, 500, (8, 16)) * 20
    x = c[rng.integers(0, 8, 500)] + rng.integers(-5, 5, (500, 16))
    group = yinyang.grouped(c, 3)
    start = np.full(500, -1), np.full(500, np.inf), np.zeros((500, group.max() + 1))
    own, upper, lower = yinyang.nearest(x, *start, c, group)
    assert (own == yinyang.squares(x, c).argmin(1)).all() and (upper < lower.min(1)).all()
    again = yinyang.nearest(np.zeros_like(x), own, upper, lower, c, group)  # vectors aren't read when bounds decide
    assert (again[0] == own).all()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = [None, "", " \n", "One", "a-B c", "ÉTÉ été x_y 1,2", "w " * 30, "b" * 50_000, "k" * 70_000 + " z", " ".join(f"w{i % 97}" for i in range(30_000)), "tie " * 25, "tie " * 25, "  İ𝟘 \x00 z"]


def resampled(docs, target, percent, least, buckets=10_000):
    def features(t):
        w = WORD.findall((t or "").translate(LOWER))
        return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    gains, out = {b: gain(b) for b in s}, []
    for i, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[bucket(g)] for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fits = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fits[: percent * len(fits) // 100], 1):
        r[4] = rank
    return sorted(str(tuple(r[:5])) for r in out)


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    prose = [" ".join(f"v{x}" for x in rng.zipf(1.5, 60) % 500) for _ in range(80)]
    docs = [*enumerate([*TEXTS, *prose]), (None, prose[0]), (None, None), (20, prose[7])]
    target = [*prose[:9], None, "", "new words here"]
    frame = spark.createDataFrame([(i, t, "x", 1, 1.5, "y") for i, t in docs], "doc_id long, text string, n_words string, weight int, score double, part string").repartition(7)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    for percent, least in ((5, 20), (100, 1), (40, 0), (0, 20)):
        got = importance.resample(frame, goal, percent=percent, least=least)
        assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == resampled(docs, target, percent, least)
    assert importance.resample(frame.limit(0), goal).count() == 0
    got = importance.resample(frame, goal.limit(0))
    assert sorted(str(tuple(r)) for r in got.collect()) == resampled(docs, [], 5, 20)


def test_crc_states_are_continued():
    import random

    r = random.Random(3)
    left, right = ([r.randbytes(n) for n in (0, 1, 3, 255, 256, 70_001)] for _ in range(2))
    crc = importance.continued(np.array([zlib.crc32(x) for x in left], np.uint32), np.array([len(x) for x in right]), np.array([zlib.crc32(x) for x in right], np.uint32))
    assert crc.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


@pytest.mark.parametrize("name", ["op12_yinyang", "op13_importance_tries"])
def test_same_rows_as_sql(spark, name):
    from notelode.llm import registry

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    got = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in df.collect())
