"""Ranked summaries against a graph that is laid out, and quotes of five levels against the plain rule."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from notelode.operators import quotes, summaries
from notelode.plans.store import blocks

SF = "/root/testdata/sf0.001"


def dense_ranks(sentences):
    n = len(sentences)
    bags = [re.findall(r"[一-鿿]|[^\W_一-鿿]+", s.lower()) for s in sentences]
    words = sorted({w for b in bags for w in b})
    df = {w: sum(w in b for b in bags) for w in words}
    m = np.array([[b.count(w) * np.log(1 + n / df[w]) for w in words] for b in bags]).reshape(n, len(words))
    norm = np.sqrt((m * m).sum(1))
    m = m / np.where(norm > 0, norm, 1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, 0)
    degree = s.sum(1)
    rank = np.ones(n)
    for _ in range(30):
        spread = sum((rank[j] / degree[j] * s[:, j] for j in range(n) if degree[j] > 1e-9), np.zeros(n))
        rank = 0.15 + 0.85 * (spread + sum(rank[j] for j in range(n) if degree[j] <= 1e-9) / n)
    return rank


def test_ranks_equal_those_of_the_whole_graph():
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        s = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta 知 识".split()) for _ in range(rng.randint(1, 9))) for _ in range(n)] + ["lonely", "---"]
        assert np.allclose(summaries.sentence_ranks(s), dense_ranks(s), atol=2e-6)


def test_summaries_of_odd_texts(spark):
    text = "Graphs rank sentences. Sentences share words.\nNothing here! 知识图谱很有用。图谱连接知识。 Words rank graphs of sentences. Words rank graphs of sentences."
    docs = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, " \n ", 1), (4, "one", 1), (4, "one", 1), (None, "x. " * 30_000, 1)], "doc_id long, text string, kept int")
    rows = sorted((r.doc_id or 0, r.sentences, r.kept, r.summary) for r in summaries.summarised(docs, 0.5).collect())
    assert [r for r in rows if r[0] != 1] == [(0, 30_000, 1, "x."), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 1, "one"), (4, 1, 1, "one")]
    (one,) = [r for r in rows if r[0] == 1]
    own = summaries.sentences_of(text)
    best = sorted(sorted(range(len(own)), key=lambda k: (-np.round(dense_ranks(own)[k], 6), k))[: len(own) // 2])
    assert one[1] == 7 and one[3] == " ".join(dict.fromkeys(own[k] for k in best))
    assert summaries.summarised(docs.limit(0)).count() == 0


def test_every_document_has_a_summary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in summaries.ranked_summaries(spark, SF).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        own = summaries.sentences_of(d.text)
        assert (rows[d.doc_id].sentences, rows[d.doc_id].summary) == (len(own), " ".join(summaries.summary_of(own, 0.6)) if own else "")
        assert len(own) > 40 or not own or np.allclose(summaries.sentence_ranks(own), dense_ranks(own), atol=2e-6)


def level(quote, block):
    bare = lambda x: re.sub("[^0-9A-Za-z一-鿿]+", "", x)
    core = quote.strip(" \t\n，。、；：？！,.!?;:\"'“”‘’（）()【】[]《》<>-–—…")
    parts = [p for p in map(bare, re.split(r"…{1,3}|\.{3,}", quote)) if len(p) >= 3]
    if quote in block:
        return 1
    if core and core in block:
        return 2
    if len(bare(quote)) >= 8 and bare(quote) in bare(block):
        return 3
    if len(parts) >= 2 and re.search(".*".join(parts), bare(block)):
        return 4
    return 5 if len(bare(quote)) >= 8 and SequenceMatcher(None, bare(quote), bare(block)).ratio() >= 0.9 else 0


def test_bounds_lose_no_near_quote():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 60)))
        b = "".join(c if rng.random() > 0.08 else rng.choice(["", "x", c + "y"]) for c in a)
        assert quotes.nearly(a, b) == (SequenceMatcher(None, a, b).ratio() >= 0.9)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert quotes.common_subsequence(a, b) == table[-1][-1]


def test_levels_of_quotes(spark):
    block = "The index, stored by bucket, is merged in the background."
    rows = [block[4:30], "“stored by bucket”…", "The index stored by bucket is", "The index ... merged in", "The index, stored by buckets, is merged in a background.", "other words altogether", "", None]
    got = [r.level for r in quotes.with_level(spark.createDataFrame([(k, q, block) for k, q in enumerate(rows)], "k long, q string, b string"), "q", "b").orderBy("k").collect()]
    assert got == [1, 2, 3, 4, 5, 0, 1, 0] and got[:7] == [level(q, block) for q in rows[:7]]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_requoted_blocks_against_the_plain_rule(spark, sf):
    all_blocks = sorted((r.doc_id, r.ordinal, r.content) for r in blocks(spark, sf).collect())
    first, expect = {}, set()
    for doc_id, ordinal, content in all_blocks:
        begin = re.sub("[^0-9A-Za-z一-鿿]+", "", content)[:16]
        if len(begin) == 16:
            if begin in first:
                d, o, block = first[begin]
                expect.add((doc_id, ordinal, d, o, level(content, block)))
            else:
                first[begin] = doc_id, ordinal, content
    got = [tuple(r) for r in quotes.requoted_blocks(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == expect


def test_blocks_of_fences_lists_and_headings_have_their_sql(spark, tmp_path):
    """The parser against its SQL on texts that the tables lack."""
    import duckdb

    from notelode import all_sql
    from notelode.operators import scalars

    rng = random.Random(8)
    lines = ["plain", "  indented", "- item", "  - inner", "1. one", "2) two", "  3. three", "| a |", "> said", "```", "  ```py", "# head", "####### seven", "", "   ", "\ttab"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "\n\n", "```\nopen"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in scalars.parsed_blocks(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(all_sql()["parsed_blocks"]).fetchall()) and len(got) > 250
