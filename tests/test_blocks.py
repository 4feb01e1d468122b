"""Blocks of sets that meet, against brute force and SQL; pairs are made where blocks meet, without a shuffle of candidates."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelode import all_queries, all_sql
from notelode.operators import blocks, semantic, similarity


def some_sets(n=160):
    r = random.Random(7)
    sets = {i: {f"n{int(r.paretovariate(0.6)) % 300}" for _ in range(r.choice((1, 3, 8, 40)))} | ({"hot", "too"} if i % 4 else set()) for i in range(n)}
    return {i: s for i, s in sets.items() if s not in [sets[k] for k in range(i)]}


@pytest.mark.parametrize("rows,values", [(8192, 1 << 19), (7, 1 << 19), (64, 50)])
def test_blocks_of_any_size_equal_brute_force(spark, monkeypatch, rows, values):
    monkeypatch.setattr(blocks, "VALUES", values)
    monkeypatch.setattr(blocks.packed, "__defaults__", (rows, None))
    sets = some_sets()
    found = spark.createDataFrame([(i, n) for i, s in sets.items() for n in s] + [(None, "hot")], "doc_id long, name string")
    got = semantic.overlapping(*semantic.distinct_sets(found), lambda n: F.ceil(0.3 * n))
    need = lambda i: -(-3 * len(sets[i]) // 10)
    want = {(a, b, n, len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) and n >= max(need(a), need(b))}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step,cells", [(1, 1), (50, 1000), (1 << 21, 1 << 22)])
def test_counts_in_chunks(monkeypatch, step, cells):
    import pandas as pd

    monkeypatch.setattr(blocks, "STEP", step)
    monkeypatch.setattr(blocks, "CELLS", cells)
    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 40, r.integers(1, 12))) for _ in range(50)]
    b = blocks._sets(pd.DataFrame({"doc_id": range(50), "n": map(len, lists), "need": 1, "names": lists}))
    side = (*(np.frombuffer(b[c], np.int64 if c == "known" else np.int32) for c in ("known", "starts", "rows")), 50)
    for same in (True, False):
        got = sorted((int(x), int(y), int(n)) for chunk in blocks.counted(side, side, same) for x, y, n in zip(*chunk))
        want = [(x, y, len(np.intersect1d(lists[x], lists[y]))) for x in range(50) for y in range(50) if not same or x < y]
        assert got == sorted(w for w in want if w[2])
        few = [(int(x), int(y), int(n)) for chunk in blocks.counted(side, side, same, 4) for x, y, n in zip(*chunk)]
        assert sorted(few) == sorted(w for w in want if w[2] >= 4)


def test_forest_keeps_the_groups(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(60)] + list(combinations(range(100, 140), 2))
    few = similarity.forest(spark.createDataFrame(edges, "x long, y long").coalesce(1)).collect()
    assert len(few) < 100

    def groups(pairs):
        own = {v: {v} for e in edges for v in e}
        for x, y in pairs:
            both = own[x] | own[y]
            for v in both:
                own[v] = both
        return {frozenset(g) for g in own.values()}

    assert groups(few) == groups(edges)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """300 documents that share four long words, in groups of ten that share more; links among some of them."""
    at = tmp_path_factory.mktemp("hot")
    letters = lambda k: "".join(chr(97 + int(d)) for d in f"{k:08d}")
    rows = [(i, "everywhere alsocommon thirdword fourthword\n" + " ".join("group" + letters(1000 * (i // 10) + j) for j in range(3 + i % 3)) + f" own{letters(i)}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, (i + 1) % 300) for i in range(0, 300, 7)], "l_orderkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def same(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = con.execute(all_sql()[name])
    columns = [d[0] for d in got.description]
    frame = all_queries()[name](spark, folder).select(*columns)
    rows = frame.collect()
    assert sorted(map(tuple, rows)) == sorted(got.fetchall()) and rows
    return frame._jdf.queryExecution().executedPlan().toString()


def test_note_groups_of_hot_names(spark, hot):
    same(spark, hot, "note_groups")


def test_backfilled_links_of_hot_names(spark, hot):
    plan = same(spark, hot, "backfilled_links")
    assert "Union" not in plan  # pairs are made once, and not stored for their two directions


def test_cross_references_of_hot_names(spark, hot):
    assert "CartesianProduct" in same(spark, hot, "cross_references")  # blocks meet, not names


def test_semantic_shares_of_hot_names(spark, hot):
    assert "Exchange" not in same(spark, hot, "semantic_shares")  # pairs are not dealt out by a key


def test_object_jaccard_of_hot_names(spark, hot):
    assert "Exchange" not in same(spark, hot, "object_jaccard")
