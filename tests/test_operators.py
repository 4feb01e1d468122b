"""Operators against brute force and edge cases that the tables lack: hot keys, odd urls, headings, statements, names."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from notelode.functions import text as X
from notelode.operators import hybrid, judgment, scalars, semantic, similarity
from notelode.operators.dense import nearest


def values(spark, column, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_urls_keep_what_tells_pages_apart(spark):
    cases = {
        "http://a.com/p?utm_source=x&id=2": "http://a.com/p?id=2", "http://a.com/p?id=2": "http://a.com/p?id=2", "HTTP://A.com/P/?UTM_SOURCE=y": "http://a.com/p",
        "http://a.com/p?id=2&fbclid=z#top": "http://a.com/p?id=2", "http://a.com/": "http://a.com/", "http://a.com": "http://a.com", " no url ": "no url", "http://a.com/p//?flag": "http://a.com/p?flag=", "": "",
    }
    assert values(spark, X.normalize_url("s"), cases) == list(cases.values())


def test_fingerprints_of_names(spark):
    cases = {"RAG（检索增强生成）": "rag", "DALL-E": "dalle", "DALL·E": "dalle", "Skills": "skill", "Queries": "query", "Boxes": "box", "status": "status", "C++": "c++", "C#": "c#", "DeepSeek V3": "deepseekv3", "(all)": "", "": ""}
    assert values(spark, X.name_fingerprint("s"), cases) == list(cases.values())


def test_polarities_and_gates_of_statements(spark):
    rows = ["模型甲优于模型乙", "模型乙劣于模型甲", "方法提升效果，成本降低利润", "plain text", "", None]
    got = judgment.polarities(spark.createDataFrame(list(enumerate(rows)), "id long, statement string"), "id").collect()
    assert sorted(map(tuple, got)) == sorted([(0, "comparison", "模型乙", "模型甲", -1), (1, "comparison", "模型乙", "模型甲", -1), (2, "change", "方法", "效果", 1), (2, "change", "成本", "利润", -1)])
    cases = {"我觉得它更有效": False, "最佳实践提升质量": True, "选择比努力更重要": False, "负载过高自动降级": False, "支持 75 种模型": False, "the method improves recall": True}
    df = spark.createDataFrame([(s, "conclusion") for s in cases], "s string, k string")
    assert [r[0] for r in df.select(judgment.judges("s", "k")).collect()] == list(cases.values())
    names = {"RAG": "ok", "x.md": "file", "A/B": "several", "--ar": "flag", "@file": "reference", "404 not found": "status code", "5.2": "version", "a": "too short", " a b": "outer space", "AGENT_TRIGGERS": "setting", "learn.org": "host", "200 份 JD": "quantity"}
    assert values(spark, judgment.noise(F.col("s")), names) == list(names.values())


def test_semantic_blocks_and_section_chunks(spark):
    text = "# One\n\nfirst line\nsecond line\n## Two\n- a\n- b\n\n| x | y |\n|---|---|\n```py\n# no heading\n\ncode\n```\n> said\n# Three\nend"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "```\nopen fence")], "doc_id long, text string")
    rows = sorted(scalars.semantic_blocks(docs).collect())
    got = [(r.kind, list(r.heading), r.content, r.start_line, r.end_line) for r in rows if r.doc_id == 1]
    assert got == [
        ("paragraph", ["One"], "first line\nsecond line", 3, 4), ("list", ["One", "Two"], "- a\n- b", 6, 7), ("table", ["One", "Two"], "| x | y |\n|---|---|", 9, 10),
        ("code", ["One", "Two"], "```py\n# no heading\n\ncode\n```", 11, 15), ("quote", ["One", "Two"], "> said", 16, 16), ("paragraph", ["Three"], "end", 18, 18),
    ]
    assert [(r.kind, r.content) for r in rows if r.doc_id == 4] == [("code", "```\nopen fence")] and not [r for r in rows if r.doc_id in (2, 3)]
    long = "# H\n\n" + "\n\n".join("p%d " % k + "word " * 60 for k in range(9)) + "\n\n```\n" + "x" * 1500 + "\n```\n\n" + "z" * 2500
    chunks = sorted(scalars.section_chunks(scalars.semantic_blocks(spark.createDataFrame([(1, long)], "doc_id long, text string"))).collect())
    assert all(len(c.content) <= 1000 or c.content.startswith("```") for c in chunks) and {c.section for c in chunks} == {"H"}
    z = [c.content for c in chunks if set(c.content) == {"z"}]
    assert sum(map(len, z)) == 2500 + 200 * (len(z) - 1)


def test_pairs_of_sets_with_a_hot_name(spark):
    rng = np.random.default_rng(4)
    sets = [{f"n{x}" for x in rng.choice(60, rng.integers(1, 9), replace=False)} | ({"hot"} if k % 3 else set()) for k in range(150)]
    sets += [set(sets[5]), set(sets[5])]
    found = spark.createDataFrame([(i, n) for i, s in enumerate(sets) for n in s], "doc_id long, name string")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    pairs = list(itertools.combinations(sorted(first.values()), 2))
    reps, rows = semantic.distinct_sets(found)
    got = {(r.doc_a, r.doc_b): r.shared for r in semantic.overlapping(reps, rows, lambda n: F.lit(3)).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in pairs if len(sets[a] & sets[b]) >= 3}
    got = {(r.doc_a, r.doc_b) for r in similarity.jaccard_pairs(found, 0.5)[1].collect()}
    assert got == {(a, b) for a, b in pairs if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_nearest_in_blocks_and_scopes(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((90, 8)).round(3)
    scope = [("a", "b", None)[k % 3] for k in range(90)]
    vectors = spark.createDataFrame([(k, v[k].tolist(), scope[k]) for k in range(90)], "vec_id long, embedding array<double>, scope string")
    queries = spark.createDataFrame([(k, v[k].tolist(), ("a", None)[k % 2]) for k in range(0, 90, 7)], "query_id long, embedding array<double>, scope string")
    for block, rows in ((4096, 50_000), (3, 20)):
        got = {}
        for r in nearest(vectors, queries, 4, 0.0, block, rows).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        for k in range(0, 90, 7):
            wanted = ("a", None)[k % 2]
            every = sorted((-round(float(v[k] @ v[j]), 4), j) for j in range(90) if j != k and (wanted is None or scope[j] == wanted) and v[k] @ v[j] >= 0)
            assert sorted(got.get(k, [])) == every[:4]
    assert nearest(vectors, queries.limit(0), 4).count() == 0


def test_sources_are_limited_in_order_of_rank(spark):
    ranked = spark.createDataFrame([(1, k, f) for k, f in enumerate("aabcbda", 1)], "query_id long, rank int, file string")
    assert [r.rank for r in hybrid.limited(ranked, 2).orderBy("rank").collect()] == [1, 2, 3, 5, 7]
    assert values(spark, hybrid.complexity("s"), ["short", "how and why", "compare a, b, c, d; e", "x" * 81]) == ["easy", "broad", "broad", "broad"]


def test_fuzzy_ratio_simhash_and_quotes(spark):
    import difflib

    rows = [("abcd", "bcde"), ("", "x"), (None, "x"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.ratio for r in scalars.fuzzy_ratio(df, "a", "b").collect()] == [0.0 if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows]
    base = "the quick brown fox jumps over the lazy dog and runs away from all the hounds"
    one, same, far = values(spark, scalars.simhash("s"), [base, base.upper() + "!!", "entirely other words stand in this line of text"])
    apart = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True))
    assert len(one) == 64 and apart(one, same) == 0 < apart(one, far)
    block = "Alpha beta, gamma delta epsilon zeta."
    quotes = {"beta, gamma": 1, "“Alpha beta”": 2, "Alpha; beta: gamma": 3, "Alpha...epsilon": 4, "nothing here": 0}
    assert values(spark, scalars.quote_level(F.col("s"), F.lit(block)), quotes) == list(quotes.values())
