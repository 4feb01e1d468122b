"""The document store: notes, blocks, mentions, objects, claims and so on, derived from the base tables.

Every derivation is a plan over Parquet scans; CTES has the same derivations as SQL, for checks against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(text, start: int = 1) -> Column:
    """0 to 255, from two hex digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), start, 2), 16, 10).cast("int")


def notes(spark, sf_dir) -> DataFrame:
    """doc_id, path, topic (a path of levels), tags, body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", F.lit("Notes"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.concat_ws(" > ", "lang", "source").alias("topic"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("body"),
    )


def blocks(spark, sf_dir) -> DataFrame:
    """doc_id, ordinal, content, hash: the non-blank lines of each document."""
    return blocks_of(table(spark, sf_dir, "documents"))


def blocks_of(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return d.select("doc_id", "ordinal", F.trim("line").alias("content")).where("content <> ''").withColumn("hash", F.md5(F.lower("content")))


def mentions(spark, sf_dir) -> DataFrame:
    """name, doc_id, ordinal: the long words (8 letters or more, of any script) of each block, once a block."""
    return mentions_of(blocks(spark, sf_dir))


def mentions_of(found: DataFrame) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}{8,})"), F.lit(1)))
    return found.select(F.explode(words).alias("name"), "doc_id", "ordinal")


def objects(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    """name, kind (entity or concept), confidence, status: a row for each name that is mentioned (in found, if given)."""
    names = (mentions(spark, sf_dir) if found is None else found).select("name").distinct()
    return with_kinds(names)


def with_kinds(names: DataFrame) -> DataFrame:
    """The attributes of objects, from their names alone."""
    return names.select(
        *names.columns,
        F.when(bucket("name") % 2 == 0, "entity").otherwise("concept").alias("kind"),
        F.round(bucket("name", 3) / 255, 2).alias("confidence"),
        F.when(bucket("name", 5) < 224, "active").otherwise("inactive").alias("status"),
    )


def claims(spark, sf_dir) -> DataFrame:
    """claim_id, statement, status, confidence, direction: the different blocks of 40 characters or more."""
    b = blocks(spark, sf_dir).where(F.char_length("content") >= 40)
    c = b.groupBy("hash").agg(F.min("content").alias("statement"))
    return c.select(
        F.col("hash").alias("claim_id"),
        "statement",
        F.when(bucket("hash") < 160, "active").when(bucket("hash") < 220, "disputed").otherwise("rejected").alias("status"),
        F.round(bucket("hash", 3) / 255, 2).alias("confidence"),
        F.when(bucket("hash", 5) % 2 == 0, "up").otherwise("down").alias("direction"),
    )


def evidence(spark, sf_dir) -> DataFrame:
    """claim_id, doc_id, ordinal, status: the blocks that hold a claim."""
    b = blocks(spark, sf_dir).where(F.char_length("content") >= 40)
    mark = F.concat_ws("-", "hash", F.col("doc_id").cast("string"))
    return b.select(F.col("hash").alias("claim_id"), "doc_id", "ordinal", F.when(bucket(mark) < 200, "active").otherwise("excluded").alias("status"))


def verifications(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """claim_id, verdict, checked_at: what labelled documents say of the claims they hold (of those in of, if given), in order of documents."""
    lab = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "supported").otherwise("unclear")
    e = evidence(spark, sf_dir) if of is None else evidence(spark, sf_dir).join(of, "claim_id", "left_semi")
    return e.join(lab.select("doc_id", verdict.alias("verdict")), "doc_id").select("claim_id", "verdict", F.col("doc_id").alias("checked_at"), "ordinal")


def change_log(spark, sf_dir) -> DataFrame:
    """id, created_at, change_kind, object_kind, object_id, detail."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("event_type").alias("change_kind"),
        F.when(F.col("user_id") % 3 == 0, "entity").when(F.col("user_id") % 3 == 1, "concept").otherwise("claim").alias("object_kind"),
        F.col("user_id").alias("object_id"),
        F.col("props").alias("detail"),
    )


def links(spark, sf_dir) -> DataFrame:
    """src, dst, status, pos: directed links between items, with repeats, self links and an order of arrival."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "pending").otherwise("suggested")
    return li.select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), status.alias("status"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("weight"),
    )


def _bucket(text: str, start: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {start}, 2))::int"


CTES = {
    "notes": """notes AS (SELECT doc_id, 'Notes/' || lang || '/' || source || '/' || doc_id || '.md' AS path, lang || ' > ' || source AS topic, [lang, source] AS tags, text AS body FROM documents)""",
    "blocks": """blocks AS (SELECT *, md5(lower(content)) AS hash FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, trim(unnest(string_split(text, chr(10))), ' ') AS content FROM documents) WHERE content <> '')""",
    "mentions": """mentions AS (SELECT unnest(list_distinct(regexp_extract_all(lower(content), '\\p{L}{8,}'))) AS name, doc_id, ordinal FROM blocks)""",
    "objects": f"""objects AS (SELECT name, CASE WHEN {_bucket('name')} % 2 = 0 THEN 'entity' ELSE 'concept' END AS kind, round({_bucket('name', 3)} / 255, 2) AS confidence, CASE WHEN {_bucket('name', 5)} < 224 THEN 'active' ELSE 'inactive' END AS status FROM (SELECT DISTINCT name FROM mentions))""",
    "claims": f"""claims AS (SELECT hash AS claim_id, statement, CASE WHEN {_bucket('hash')} < 160 THEN 'active' WHEN {_bucket('hash')} < 220 THEN 'disputed' ELSE 'rejected' END AS status, round({_bucket('hash', 3)} / 255, 2) AS confidence, CASE WHEN {_bucket('hash', 5)} % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT hash, min(content) AS statement FROM blocks WHERE length(content) >= 40 GROUP BY hash))""",
    "evidence": f"""evidence AS (SELECT hash AS claim_id, doc_id, ordinal, CASE WHEN {_bucket("hash || '-' || doc_id")} < 200 THEN 'active' ELSE 'excluded' END AS status FROM blocks WHERE length(content) >= 40)""",
    "verifications": """verifications AS (SELECT claim_id, CASE WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'supported' ELSE 'unclear' END AS verdict, doc_id AS checked_at, ordinal FROM evidence JOIN labels USING (doc_id))""",
    "change_log": """change_log AS (SELECT event_id AS id, ts AS created_at, event_type AS change_kind, CASE user_id % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'concept' ELSE 'claim' END AS object_kind, user_id AS object_id, props AS detail FROM events)""",
    "links": """links AS (SELECT l_orderkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'pending' ELSE 'suggested' END AS status, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS weight FROM lineitem)""",
}
_NEEDS = {"blocks": [], "mentions": ["blocks"], "objects": ["mentions"], "claims": ["blocks"], "evidence": ["blocks"], "verifications": ["evidence"]}


def with_tables(*names: str) -> str:
    """A WITH clause that derives the named tables and what they need."""
    seen: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in seen:
            seen.append(name)

    for x in names:
        add(x)
    return "WITH " + ", ".join(CTES[x] for x in seen) + " "
