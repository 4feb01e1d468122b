"""Pairs that share three names or more, and codes within twelve bits, against brute force; rows that meet at hot keys."""

import random
from collections import Counter
from itertools import combinations

import pytest

from notelode.operators import hamming
from notelode.operators.overlap import pairs_of, sharing


def tables(spark, sets):
    df = Counter(n for own in sets.values() for n in own)
    rows = [(i, n, df[n]) for i, own in sets.items() for n in own]
    return spark.createDataFrame(rows, "doc_id long, name string, df long").repartition(4)


def brute(sets):
    return sorted((a, b, n) for a, b in combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= 3)


@pytest.mark.parametrize("hot,light", [(64, 24), (5, 24), (5, 3), (0, 4), (1000, 24)])
def test_sharing_equals_brute_force(spark, hot, light):
    r = random.Random(1)
    sets = {i: {f"n{int(r.paretovariate(0.6)) % 400}" for _ in range(r.choice((1, 3, 8, 30)))} for i in range(150)}
    sets |= {900: {"only"}, 901: {"h1", "h2", "h3"}, 902: {"h1", "h2", "h3"}, 903: {f"n{i}" for i in range(60)}}
    got = sorted((x.doc_a, x.doc_b, x.shared) for x in sharing(tables(spark, sets), hot, light).collect())
    assert got == brute(sets)


def test_hot_names_alone_make_no_pairs_that_meet(spark):
    sets = {i: {"everywhere", "also everywhere", f"own{i}", f"pair{i // 2}", f"too{i // 2}"} for i in range(400)}
    rows = tables(spark, sets)
    assert sorted((x.doc_a, x.doc_b, x.shared) for x in sharing(rows).collect()) == [(i, i + 1, 4) for i in range(0, 400, 2)]
    assert pairs_of(rows.where("df <= 64").select("doc_id", "name"), "name").count() == 400  # two for each pair, not 400 ** 2 / 2
    assert sharing(rows.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 3, 7, 12])
def test_hamming_join_is_exact(spark, most):
    r = random.Random(2)
    found = {}
    for i in range(60):
        code = r.getrandbits(64) if i % 3 == 0 else code ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 15)))  # noqa: F821
        found[i] = code
    found |= {100 + i: found[3] for i in range(40)} | {200: 0, 201: (1 << 64) - 1, 202: 0xFFF, 203: 0x1FFF}
    rows = spark.createDataFrame([(i, c >> 32, c & 0xFFFFFFFF) for i, c in found.items()], "doc_id long, hi long, lo long")
    first = {}
    for i in sorted(found):
        first.setdefault(found[i], i)
    want = sorted((min(a, b), max(a, b), (x ^ y).bit_count()) for (x, a), (y, b) in combinations(first.items(), 2) if (x ^ y).bit_count() <= most)
    assert sorted((x.doc_a, x.doc_b, x.distance) for x in hamming.hamming_pairs(rows, most).collect()) == want
    assert hamming.hamming_pairs(rows.limit(0), most).count() == 0


def test_light_rewrite_is_found_and_copies_are_one(spark):
    base = "This note tells how a store of documents is kept in order and how its parts are found again by their names. " * 5
    docs = [(1, base), (2, base.replace("kept in order", "kept in good order")), (3, base), (4, "Entirely other words about cooking, weather and the sea. " * 9), (5, "short"), (6, None), (7, "")]
    got = hamming.audited(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.earlier) for r in got] == [(2, 1)] and got[0].jaccard >= 0.78 and got[0].distance <= 12
