"""Budgets handed on in order, and conflicts under their cap, against plain loops."""

import pytest

from notelode.operators.judgment import conflicting
from notelode.operators.scalars import allotted


def plain(sizes, budget):
    rest, given = budget, 0
    for k, size in enumerate(sizes):
        own = min(size, rest // (len(sizes) - k))
        rest, given = rest - own, given + own
    return len(sizes), given, rest


@pytest.mark.parametrize("budget", [0, 1, 7, 100, 1000])
def test_budget_equals_plain_loop(spark, budget):
    groups = {"hot": [(i * 7919) % 23 for i in range(5000)], "few": [5, 0, 900, 3], "one": [4000], None: [1, 2, 3], "zeros": [0] * 50, "late": [0] * 300 + [50] * 3}
    rows = [(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes)] + [("null", 0, None)]
    got = {r.grp: (r.notes, r.given, r.rest) for r in allotted(spark.createDataFrame(rows, "grp string, pos long, size long"), budget).collect()}
    assert got == {g: plain(sizes, budget) for g, sizes in groups.items()} | {"null": (1, 0, budget)}


def test_conflicts_are_capped_before_contexts(spark):
    row = lambda i, d, topic, scope="": (i, "comparison", "a", "b", d, topic, scope)
    # the first ten of the positive side are of another topic, so none of them meets the negative one
    rows = [row(i, 1, "other") for i in range(10)] + [row(50, 1, "here"), row(60, -1, "here", "s"), row(5, -1, "third", "s"), row(5, 1, "third", "s"), row(5, 1, "third", "s")]
    schema = "doc_id long, kind string, subject string, target string, direction int, topic string, scope string"
    got = lambda side: sorted((r.claim_a, r.claim_b) for r in conflicting(spark.createDataFrame(rows, schema), side).collect())
    assert got(10) == [(5, 60)] and got(100) == [(5, 60), (50, 60)]
    assert conflicting(spark.createDataFrame([], schema)).count() == 0
