"""Sources and sinks of notes: folders of Markdown, front matter, feeds, transcripts, logs, index pages, zones by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of tools, which hold no notes.
TOOL_FOLDERS = ("node_modules", "__pycache__", "venv", "build", "dist")
SURVEY = "_综述.md"


def scan_notes(spark: SparkSession, folder: str, surveys: bool = False, hidden: bool = False, readme: bool = False) -> DataFrame:
    """path, name, body, size, modified of every Markdown file below folder; surveys, hidden files and READMEs on demand."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    m = F.col("_metadata")
    rows = files.select(m["file_path"].alias("path"), m["file_name"].alias("name"), F.col("value").alias("body"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified"))
    below = F.substring("path", len(folder.rstrip("/").removeprefix("file:")) + 1, 1 << 20)  # what is above the folder may be hidden
    rows = rows.where(~F.col("path").rlike("/(" + "|".join(TOOL_FOLDERS) + ")/"))
    if not hidden:
        rows = rows.where(~below.rlike(r"/\.[^/.]"))
    if not surveys:
        rows = rows.where(~F.url_decode("name").endswith(SURVEY))
    return rows if readme else rows.where(F.lower("name") != "readme.md")


def changed_files(old: DataFrame, new: DataFrame, seconds: float = 0.5) -> DataFrame:
    """path, change of two fingerprints (path, size, modified): added, deleted or modified files; times that differ by
    ``seconds`` at most are the same."""
    a, b = old.select("path", F.col("size").alias("s"), F.col("modified").alias("m")), new.select("path", "size", "modified")
    both = a.join(b, "path", "full_outer")
    apart = F.abs(F.col("modified").cast("double") - F.col("m").cast("double")) > seconds
    change = F.when(F.col("m").isNull(), "added").when(F.col("modified").isNull(), "deleted").when(apart | (F.col("s") != F.col("size")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


_HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"


def front_matter(notes: DataFrame) -> DataFrame:
    """notes with head (a map of the keys and values between the first two --- lines) and body without it.

    Lists, on one line or with a dash each, are values with commas (see listed); folded text goes on one line.
    """
    head = F.regexp_extract("body", _HEAD, 1)
    flat = F.regexp_replace(F.regexp_replace(head, r"\r?\n\s*- +", ", "), r"\s*[>|]-?\r?\n[ \t]+|\r?\n[ \t]+", " ")
    lines = F.filter(F.split(flat, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\w-]+\s*:", ""), r"^\s*,\s*", "")), "^([\"'])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("k"), value(x).alias("v")))
    return notes.withColumn("head", F.map_from_entries(pairs)).withColumn("body", F.regexp_replace("body", _HEAD, ""))


def listed(value) -> Column:
    """The items of a front-matter value: [a, b] or a, b."""
    bare = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def with_front_matter(notes: DataFrame) -> DataFrame:
    """notes with head written before body again."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("head")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return notes.withColumn("body", F.when(F.size("head") > 0, F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), "body")).otherwise(F.col("body")))


def pending(notes: DataFrame, done: DataFrame) -> DataFrame:
    """notes whose content (sha) was not seen before, in done (sha): each different content once."""
    hashed = notes.withColumn("sha", F.sha2("body", 256))
    return hashed.dropDuplicates(["sha"]).join(done.select("sha"), "sha", "left_anti")


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """title, link, published of the items of RSS and Atom files in folder, each link once, by Spark's XML source."""
    xml = spark.read.format("xml")
    rss = xml.option("rowTag", "item").schema("title string, link string, pubDate string").load(folder)
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href: string>, updated string").load(folder)
    rows = rss.select("title", F.trim("link").alias("link"), F.col("pubDate").alias("published")).unionAll(atom.select("title", F.col("link._href"), "updated"))
    return rows.where("link is not null").groupBy("link").agg(F.min_by(F.struct("title", "published"), F.struct("published", "title")).alias("i")).select("i.title", "link", "i.published")


def transcripts(rows: DataFrame) -> DataFrame:
    """Notes (name, body) from rows (title, said): one for each title, with what was said in order of the column at."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x.said), "\n")  # of one recording
    return rows.groupBy("title").agg(said.alias("body")).select(F.concat("title", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("body"))


def fetch(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ids (id)."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def search_notes(notes: DataFrame, words: str, most: int = 20) -> DataFrame:
    """The first ``most`` notes, by path, that hold the words as they stand, case aside."""
    return notes.where(F.contains(F.lower("body"), F.lit(words.lower()))).orderBy("path").limit(most)


def write_topics(notes: DataFrame, folder: str) -> None:
    """One folder of Parquet for each topic."""
    notes.repartition("topic", F.pmod(F.xxhash64("path"), F.lit(8))).write.mode("overwrite").partitionBy("topic").parquet(folder)


def write_index(notes: DataFrame, folder: str) -> None:
    """An index page from notes (topic, name, tags): topics in order with their notes, then tags by use. Text files in order."""
    tree = notes.select(F.lit(0).alias("part"), F.col("topic").alias("k1"), F.col("name").alias("k2"), F.concat(F.lit("- "), "topic", F.lit(" / "), "name").alias("line"))
    tags = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    tags = tags.select(F.lit(1).alias("part"), F.format_string("%012d", 10**11 - F.col("n")).alias("k1"), F.lower("tag").alias("k2"), F.format_string("#%s (%d)", "tag", "n").alias("line"))
    tree.unionByName(tags).orderBy("part", "k1", "k2").select("line").write.mode("overwrite").text(folder)


def append_log(lines: DataFrame, folder: str) -> None:
    """Append lines (ts, kind, message) to the text files of a log."""
    lines.select(F.concat_ws(" ", F.date_format("ts", "'['yyyy-MM-dd HH:mm:ss']'"), "kind", "message")).write.mode("append").text(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """ts, kind, message of a log's lines; others are left out."""
    part = lambda k: F.regexp_extract("value", r"^\[([^\]]+)\] (\S+) (.*)$", k)
    rows = spark.read.text(folder).select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("kind"), part(3).alias("message"))
    return rows.where("ts is not null")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A similarity graph as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
