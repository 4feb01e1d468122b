"""Statements in conflict, all of them, against plain loops: frequent contexts, and statements that say both things."""

import random

import pytest

from notelode.operators import judgment
from notelode.plans.catalog import SQL

SCHEMA = "doc_id long, kind string, subject string, target string, direction int, topic string, scope string"


def assertions():
    """A context with 40 statements a side, and mixed ones: repeated, of several topics and scopes, for and against at once."""
    dice = random.Random(3)
    rows = [(i, "comparison", "a", "b", 1 if i % 2 else -1, "hot", "") for i in range(80)]
    rows += [(100 + dice.randrange(25), "change", dice.choice("ab"), "c", dice.choice((1, -1)), dice.choice(("t", "u", None)), dice.choice(("", "", "s", "r", None))) for _ in range(160)]
    # a null doc_id is in conflict with none, and takes no one's place
    nulls = [(None, "change", "a", "d", 1, "t", ""), *((i, "change", "a", "d", d, "t", "") for i in (300, 301, 302) for d in (1, -1))]
    return rows + [(None, "change", "a", "c", 1, "t", "s"), (200, "change", None, "c", 1, "t", "s"), (201, "change", None, "c", -1, "t", "s"), *nulls] + rows[-9:]


def all_conflicts(rows):
    met = lambda a, b: (a[5] is not None and a[5] == b[5]) or (a[6] and a[6] == b[6])
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    return {(min(a[0], b[0]), max(a[0], b[0]), *a[1:4]) for a in known for b in known if a[1:4] == b[1:4] and a[4] == 1 and b[4] == -1 and a[0] != b[0] and met(a, b)}


@pytest.mark.parametrize("more", [{}, {"block": 3}])
def test_all_pairs_of_a_frequent_context(spark, more):
    rows = assertions()
    got = [tuple(r) for r in judgment.conflicting(spark.createDataFrame(rows, SCHEMA), **more).collect()]
    assert len(got) == len(set(got)) and set(got) == all_conflicts(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of one language and source, so that contexts are frequent, with a null and a repeated doc_id."""
    at = tmp_path_factory.mktemp("frequent")
    rows = [(i, "en", "web") for i in [*range(1500), 1501, 1501, None]]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").selectExpr("*", "'x' AS text").write.parquet(f"{at}/documents.parquet")
    return str(at)


def same(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = con.execute(SQL[name])
    columns = [d[0] for d in got.description]
    rows = sorted(map(tuple, getattr(judgment, name)(spark, folder).select(*columns).collect()))
    assert rows == sorted(got.fetchall())
    return rows


def test_polarity_conflicts_of_frequent_contexts(spark, folder):
    # statements 0 and 2 modulo 12 (and of one topic) are in conflict, and so are 3 and 4, and 5 and 6
    rows = same(spark, folder, "polarity_conflicts")
    classes = judgment.polarity_classes(spark, folder).collect()
    assert len(rows) > 10 * 10 * len({tuple(r[2:]) for r in rows})
    assert len({r[:2] for r in rows}) <= sum(c.positives * c.negatives for c in classes)


def firsts(rows, most):
    of = {}
    for a, b, *_ in all_conflicts(rows):
        of.setdefault(a, set()).add(b)
        of.setdefault(b, set()).add(a)
    return sorted((a, b, k + 1) for a, bs in of.items() for k, b in enumerate(sorted(bs)[:most]))


@pytest.mark.parametrize("most", [1, 2, 50])
def test_first_opposites_of_all_conflicts(spark, most):
    rows = assertions()
    assert sorted(tuple(r) for r in judgment.opposites(spark.createDataFrame(rows, SCHEMA), most).collect()) == firsts(rows, most)


def test_opposite_statements_of_frequent_contexts(spark, folder):
    # every statement that is in conflict has its first two, not only the first ten of a side
    said = judgment.polarities(judgment.statements(spark, folder), "doc_id", "topic", "scope")
    rows = [tuple(r) for r in said.select("doc_id", *judgment.KEY, "direction", "topic", "scope").collect()]
    assert same(spark, folder, "opposite_statements") == firsts(rows, 2)
