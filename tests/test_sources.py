"""Sources, sinks and streams on small folders."""

import datetime as dt

from pyspark.sql import functions as F

from notelode.sources import files
from notelode.streaming import changes


def test_scan_front_matter_and_changes(spark, tmp_path):
    folder = tmp_path / "vault"
    for d in (".hidden", "node_modules", "sub"):
        (folder / d).mkdir(parents=True)
    (folder / ".hidden/x.md").write_text("no")
    (folder / "node_modules/y.md").write_text("no")
    (folder / "README.md").write_text("no")
    (folder / "topic_综述.md").write_text("survey")
    (folder / "sub/a.md").write_text("---\ntopic: en > x\ntags: [a, 'b c']\nlong: >\n  folded\n  text\nlist:\n  - one\n  - two\nquoted: \"q\"\n---\nBody\n")
    (folder / "b.md").write_text("Plain\n")
    rows = {r["name"]: r for r in files.front_matter(files.scan_notes(spark, str(folder))).collect()}
    assert set(rows) == {"a.md", "b.md"}
    head = rows["a.md"]["head"]
    assert head["topic"] == "en > x" and head["long"] == "folded text" and head["list"] == "one, two" and head["quoted"] == "q"
    notes = files.front_matter(files.scan_notes(spark, str(folder)))
    tags = notes.where("name = 'a.md'").select(files.listed(F.col("head")["tags"]).alias("t"), files.listed(F.col("head")["list"]).alias("l")).first()
    assert (tags.t, tags.l) == (["a", "b c"], ["one", "two"])
    again = files.front_matter(files.with_front_matter(notes))
    assert {r["name"]: (r["head"], r["body"]) for r in again.collect()} == {n: (r["head"], r["body"]) for n, r in rows.items()}
    assert files.scan_notes(spark, str(folder), surveys=True, readme=True).count() == 4
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", 1, t), ("b", 1, t), ("c", 1, t)], "path string, size long, modified timestamp")
    new = spark.createDataFrame([("a", 1, t + dt.timedelta(milliseconds=300)), ("b", 1, t + dt.timedelta(seconds=2)), ("d", 1, t)], "path string, size long, modified timestamp")
    assert {r.path: r.change for r in files.changed_files(old, new).collect()} == {"b": "modified", "c": "deleted", "d": "added"}
    assert [r["name"] for r in files.search_notes(notes, "pLAIN").collect()] == ["b.md"]


def test_feeds_transcripts_logs_and_sinks(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds/a.xml").write_text("<rss><channel><item><title>A</title><link>http://a/1</link><pubDate>x</pubDate></item><item><title>A again</title><link>http://a/1</link><pubDate>y</pubDate></item></channel></rss>")
    (tmp_path / "feeds/b.xml").write_text('<feed><entry><title>B</title><link href="http://b/2"/><updated>2024</updated></entry></feed>')
    assert sorted(map(tuple, files.feed_items(spark, str(tmp_path / "feeds")).collect())) == [("A", "http://a/1", "x"), ("B", "http://b/2", "2024")]
    said = spark.createDataFrame([("t", 2, "world"), ("t", 1, "hello")], "title string, at int, said string")
    assert files.transcripts(said).first().body == "# t\n\nhello\nworld"
    lines = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "ingest", "two words")], "ts timestamp, kind string, message string")
    for _ in range(2):
        files.append_log(lines, str(tmp_path / "log"))
    assert [tuple(r) for r in files.read_log(spark, str(tmp_path / "log")).collect()] == [tuple(lines.first())] * 2
    notes = spark.createDataFrame([("b", "n2", ["x", "y"]), ("a", "n1", ["y"])], "topic string, name string, tags array<string>")
    files.write_index(notes, str(tmp_path / "index"))
    assert [r.value for r in spark.read.text(str(tmp_path / "index")).coalesce(1).collect()] and sorted(r.value for r in spark.read.text(str(tmp_path / "index")).collect()) == ["#x (1)", "#y (2)", "- a / n1", "- b / n2"]
    files.write_graph(notes.select("name"), notes.select("topic"), str(tmp_path / "graph"))
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "graph"))] == [2, 2]
    files.write_topics(notes.withColumn("path", F.col("name")), str(tmp_path / "topics"))
    assert spark.read.parquet(str(tmp_path / "topics")).count() == 2
    chunks = spark.range(10)
    assert files.fetch(chunks, chunks.where("id in (3, 4)")).count() == 2


def test_merges_keep_the_last_version_and_may_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "state")
    merge = changes.merge_into(folder, "event_id", "ts")
    t = lambda n: dt.datetime(2024, 1, n)
    batches = {0: [(1, t(2), "b"), (1, t(1), "a"), (2, t(1), "x")], 2: [(1, t(1), "late"), (2, t(3), "y"), (3, t(1), "z")], 5: [(3, t(2), "w")]}
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")
    for number, rows in batches.items():
        merge(frame(rows), number)
    expect = {1: "b", 2: "y", 3: "w"}
    assert {r.event_id: r.kind for r in changes.latest(spark, folder).collect()} == expect
    merge(frame(batches[5]), 5)  # delivered again
    assert {r.event_id: r.kind for r in changes.latest(spark, folder).collect()} == expect
    assert changes.latest(spark, folder, 0) is None and {r.event_id: r.kind for r in changes.latest(spark, folder, 2).collect()} == {1: "b", 2: "x"}


def test_streams_of_bursts_and_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(k % 5, t + dt.timedelta(minutes=10 * (k % 5)), 1 + k % 2, "click", 1.0, "{}") for k in range(10)] + [(9, t + dt.timedelta(days=9), 1, "view", 1.0, "{}")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(2).write.parquet(str(tmp_path / "in"))

    def run(name, plan, mode):
        stream = changes.read_changes(spark, str(tmp_path / "in"), events.schema, 10)
        q = plan(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert sorted(r.event_id for r in run("seen", changes.once, "append").collect()) == [0, 1, 2, 3, 4, 9]
    got = run("burst", changes.bursts, "append")
    assert sorted((r.user_id, r.n) for r in got.collect()) == sorted((r.user_id, r.n) for r in changes.bursts(events.where("event_id <> 9")).collect())
    folder = str(tmp_path / "state")
    stream = changes.read_changes(spark, str(tmp_path / "in"), events.schema, 1)
    q = stream.writeStream.foreachBatch(changes.merge_into(folder)).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in changes.latest(spark, folder).collect()) == [0, 1, 2, 3, 4, 9]
