"""Every query of the library's own operators gives the rows of its SQL in another engine."""

import math
import os

import pytest

from notelode import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows(spark, duck, name):
    df = all_queries()[name](spark, SF)
    got = duck.execute(all_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda some, names: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in some), key=str)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_mmr_prefers_other_vectors(spark):
    from notelode.operators.retrieval import mmr

    hits = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, vec_id long, score double, embedding array<double>")
    assert [r.vec_id for r in sorted(mmr(hits, k=3).collect(), key=lambda r: r["rank"])] == [1, 3, 2]


def test_greedy_chunks_bounds_and_overlap(spark):
    from notelode.operators.text import greedy_chunks

    docs = spark.createDataFrame([(1, "\n".join("x" * 300 for _ in range(9))), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.chunk, r.content) for r in greedy_chunks(docs, 1000, 200).collect())
    assert {r[0] for r in rows} == {1} and all(len(r[2]) <= 1000 for r in rows)
    assert all(b[2].startswith(a[2][-200:]) for a, b in zip(rows, rows[1:]))


def test_streams_equal_batches(spark, tmp_path):
    from notelode.streaming import changes
    from notelode.plans.store import table

    events = table(spark, SF, "events").limit(300)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = changes.read_changes(spark, str(tmp_path / "in"), events.schema, 1)
    q = changes.daily_digest(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("digest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    from pyspark.sql import functions as F

    batch = changes.daily_digest(spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("digest").collect())) == sorted(map(tuple, batch.collect()))


def test_notes_from_files(spark, tmp_path):
    from notelode.sources.files import front_matter, pending, scan_notes

    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "a.md").write_text("---\ntopic: en > src1\ntags: [a, b]\n---\nBody\n")
    (tmp_path / "b.md").write_text("Plain\n")
    rows = {r["name"]: r for r in front_matter(scan_notes(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.md", "b.md"}
    assert rows["a.md"]["head"]["topic"] == "en > src1" and rows["a.md"]["body"] == "Body\n" and rows["b.md"]["body"] == "Plain\n"
    notes = scan_notes(spark, str(tmp_path))
    done = pending(notes, spark.createDataFrame([], "sha string")).select("sha")
    assert done.count() == 2 and pending(notes, done).count() == 0
