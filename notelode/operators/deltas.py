"""A store that is brought up to date by what changed, and not derived again.

Blocks, and the counts of objects, relations and claims that rest on them, are kept as signed rows: a version holds what one change
added and took away, and a row's state is the sum over versions. So an update writes as much as changed, whatever the size
of the store, and reads the buckets of the changed documents and of the touched keys alone. A change of documents becomes a
change of their blocks; those of documents whose blocks really changed become changes of mentions, relations and evidence;
these, summed by key, change the counts; keys whose counts cross a bound open or close items of the review queue.

Rows lie in Parquet by version and bucket of their key. A version counts once its last table, the list of what it replaces, is
written, so an update that was broken off is not seen, and the same change given again afterwards changes nothing. Versions are
merged into one when there are many.

Null texts are documents without blocks. A change must name each doc_id once, none null; gone documents that were not there are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.plans.catalog import query
from notelode.plans.checkpoints import dropped, shared_dir, stored
from notelode.plans.store import blocks_of, mentions_of, table
from notelode.plans.store import with_tables as W

BUCKETS, MOST_VERSIONS, CLAIM_CHARS = 64, 16, 40

#: Table: its key, of which the first column gives the bucket, and its sums.
TABLES = {
    "blocks": ("doc_id long, ordinal int, content string, hash string", "n long"),
    "objects": ("name string", "blocks long, docs long"),
    "relations": ("source string, target string", "blocks long, docs long"),
    "claims": ("claim_id string, content string", "blocks long, docs long"),
}
#: Kind of item, table, when it holds (blocks, documents, blocks before), reason.
RULES = (
    ("lonely_object", "objects", lambda blocks, docs, before: docs == 1, "in one document alone"),
    ("orphan_claim", "claims", lambda blocks, docs, before: (blocks == 0) & (before > 0), "no block left"),
)
QUEUE = "kind string, key string, status string, reason string"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def object_rows(blocks: DataFrame) -> DataFrame:
    return mentions_of(blocks).select("name", "doc_id")


def relation_rows(blocks: DataFrame) -> DataFrame:
    """The first and the last name of each block that has two."""
    ends = mentions_of(blocks).groupBy("doc_id", "ordinal").agg(F.min("name").alias("source"), F.max("name").alias("target"))
    return ends.where("source <> target").select("source", "target", "doc_id")


def claim_rows(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.char_length("content") >= CLAIM_CHARS).select(F.col("hash").alias("claim_id"), "content", "doc_id")


def sided(rows_of, old: DataFrame, new: DataFrame) -> DataFrame:
    """What a function of blocks makes of the old (-1) and of the new ones (1)."""
    return rows_of(old).withColumn("side", F.lit(-1)).unionByName(rows_of(new).withColumn("side", F.lit(1)))


def count_changes(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, blocks, docs: by how many blocks and documents each key grew or shrank, from rows of whole documents (doc_id, side)."""
    old, new = F.count_if(F.col("side") < 0), F.count_if(F.col("side") > 0)
    there = lambda n: (n > 0).cast("long")
    per = rows.groupBy(*key, "doc_id").agg((new - old).alias("b"), (there(new) - there(old)).alias("d"))
    return per.where("b <> 0 or d <> 0").groupBy(*key).agg(F.sum("b").alias("blocks"), F.sum("d").alias("docs")).where("blocks <> 0 or docs <> 0")


class Store:
    """The store below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_versions: int = MOST_VERSIONS):
        self.spark, self.path, self.buckets, self.most_versions = spark, path.rstrip("/"), buckets, most_versions

    def bucket(self, key) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folders(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.path}/done")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.getName().split("=")[1]) for x in found if fs.exists(path(x, "_SUCCESS")))

    def versions(self) -> list[int]:
        """The versions that count: from the last one that replaces those before it."""
        known = self._folders()
        if not known:
            return []
        marks = self.spark.read.schema("version int, whole boolean").parquet(*[f"{self.path}/done/version={v}" for v in known])
        whole = marks.where("whole").agg(F.max("version")).first()[0]
        return [v for v in known if whole is None or v >= whole]

    def _rows(self, name: str, schema: str, buckets: list[int] | None, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, version int, bucket int")
        rows = self.spark.read.schema(f"{schema}, version int, bucket int").option("basePath", f"{self.path}/{name}")
        rows = rows.parquet(*[f"{self.path}/{name}/version={v}" for v in versions])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def state(self, name: str, buckets: list[int] | None = None, versions: list[int] | None = None) -> DataFrame:
        """The rows of a table that are there, with their sums; of these buckets alone, if given."""
        key, sums = TABLES[name]
        rows = self._rows(name, f"{key}, {sums}", buckets, self.versions() if versions is None else versions)
        total = rows.groupBy(*names_of(key)).agg(*[F.sum(c).alias(c) for c in names_of(sums)])
        return total.where(" or ".join(f"{c} <> 0" for c in names_of(sums)))

    def queue(self, buckets: list[int] | None = None, versions: list[int] | None = None) -> DataFrame:
        """kind, key, status, reason, version: the newest row of each item."""
        rows = self._rows("queue", QUEUE, buckets, self.versions() if versions is None else versions)
        return rows.groupBy("kind", "key").agg(F.max_by(F.struct("status", "reason", "version"), "version").alias("r")).select("kind", "key", "r.*")

    def claims(self) -> DataFrame:
        """claim_id, statement, blocks, docs: the contents that make a claim differ in case alone, the least is its statement."""
        return self.state("claims").groupBy("claim_id").agg(F.min("content").alias("statement"), F.sum("blocks").alias("blocks"), F.sum("docs").alias("docs"))

    def _write(self, name: str, rows: DataFrame, first: str, version: int) -> DataFrame:
        at = f"{self.path}/{name}/version={version}"
        rows.withColumn("bucket", self.bucket(first)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        schema = QUEUE if name == "queue" else ", ".join(TABLES[name])
        return self.spark.read.schema(f"{schema}, bucket int").option("basePath", at).parquet(at)

    def _publish(self, version: int, whole: bool) -> None:
        self.spark.createDataFrame([(version, whole)], "version int, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/version={version}")

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        return [r.bucket for r in rows.select("bucket").distinct().collect()]  # numbers of buckets, a fixed bound

    def apply(self, changed: DataFrame, gone: DataFrame | None = None) -> int:
        """Bring in documents that are new or other than before (doc_id, text), and take out those that are gone (doc_id)."""
        seen = self.versions()
        version = max(self._folders(), default=0) + 1
        ids = changed.select("doc_id") if gone is None else changed.select("doc_id").union(gone.select("doc_id"))
        ids = stored(ids.distinct().withColumn("bucket", self.bucket("doc_id")))
        key = names_of(TABLES["blocks"][0])
        old = self.state("blocks", self._buckets(ids), seen).join(ids.select("doc_id"), "doc_id", "left_semi").select(*key)
        new = blocks_of(changed if gone is None else changed.join(gone.select("doc_id"), "doc_id", "left_anti")).select(*key)
        both = stored(sided(lambda b: b, old, new))
        delta = both.groupBy(*key).agg(F.sum("side").alias("n")).where("n <> 0")
        delta = self._write("blocks", delta, "doc_id", version)

        # whole documents are looked at where a block changed, since a name may stay in another block of it
        touched = stored(both.join(delta.select("doc_id").distinct(), "doc_id", "left_semi"))
        olds, news = touched.where("side < 0").drop("side"), touched.where("side > 0").drop("side")
        items = []
        for name, rows_of in (("objects", object_rows), ("relations", relation_rows), ("claims", claim_rows)):
            parts = names_of(TABLES[name][0])
            written = self._write(name, count_changes(sided(rows_of, olds, news), parts), parts[0], version)
            items += [self._crossings(name, written, rule, seen) for rule in RULES if rule[1] == name]
        self._write("queue", reduce(DataFrame.unionByName, items), "key", version)
        self._publish(version, False)
        dropped(ids, both, touched)
        if len(seen) >= self.most_versions:
            self.merge()
        return version

    def _crossings(self, name: str, delta: DataFrame, rule: tuple, seen: list[int]) -> DataFrame:
        """Items of a rule that open or close, since the sums of a key have changed. A reviewed item stays so until it closes."""
        kind, _, holds, reason = rule
        first, buckets = names_of(TABLES[name][0])[0], self._buckets(delta)
        change = delta.groupBy(first).agg(F.sum("blocks").alias("b"), F.sum("docs").alias("d"))
        was = self.state(name, buckets, seen).groupBy(first).agg(F.sum("blocks").alias("was_b"), F.sum("docs").alias("was_d"))
        items = self.queue(buckets, seen).where(F.col("kind") == kind).select(F.col("key").alias(first), F.col("status").alias("last"))
        rows = change.join(was, first, "left").join(items, first, "left").fillna(0, ["was_b", "was_d"])
        on = holds(F.col("was_b") + F.col("b"), F.col("was_d") + F.col("d"), F.col("was_b"))
        listed = F.coalesce(F.col("last") != "closed", F.lit(False))
        status = F.when(on & ~listed, "open").when(~on & listed, "closed")
        return rows.select(F.lit(kind).alias("kind"), F.col(first).alias("key"), status.alias("status"), F.lit(reason).alias("reason")).where("status is not null")

    def review(self, items: DataFrame, status: str = "dismissed") -> int:
        """Give open items (kind, key) another status, which they keep until their reason is gone."""
        version = max(self._folders(), default=0) + 1
        q = self.queue().where("status <> 'closed'").join(items.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
        for name, (key, sums) in TABLES.items():
            self._write(name, self.spark.createDataFrame([], f"{key}, {sums}"), names_of(key)[0], version)
        self._write("queue", q.select("kind", "key", F.lit(status).alias("status"), "reason"), "key", version)
        self._publish(version, False)
        return version

    def merge(self) -> int:
        """One version in place of all; readers that have begun still find the old ones, which `clean` deletes."""
        version = max(self._folders(), default=0) + 1
        for name in TABLES:
            self._write(name, self.state(name), names_of(TABLES[name][0])[0], version)
        self._write("queue", self.queue().drop("version"), "key", version)
        self._publish(version, True)
        return version

    def clean(self) -> None:
        """Delete the versions that a merged one replaces."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for v in set(self._folders()) - set(self.versions()):
            for name in ("done", "queue", *TABLES):  # what tells that it counts goes first
                fs.delete(path(f"{self.path}/{name}/version={v}"), True)


# --- the store after edits ------------------------------------------------------------------------------------------------

_EDITED = "fd AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0), "
_AFTER = "WITH " + _EDITED + W("mentions")[5:].replace("FROM documents", "FROM fd")


def edited(spark, sf_dir) -> Store:
    """A store of most documents, in which the others then come, every fifth loses its first line and every eleventh goes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.apply(d.where("doc_id % 9 <> 0"))
    cut = F.when(F.col("doc_id") % 5 == 1, F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(F.col("text"))
    store.apply(d.where("doc_id % 9 = 0 or doc_id % 5 = 1").withColumn("text", cut), d.where("doc_id % 11 = 0").select("doc_id"))
    return store


@query(_AFTER + ", rl AS (SELECT doc_id, ordinal, min(name) AS a, max(name) AS b FROM mentions GROUP BY ALL HAVING min(name) <> max(name)) SELECT 'object' AS kind, name AS key, count(*) AS blocks, count(DISTINCT doc_id) AS docs FROM mentions GROUP BY name UNION ALL SELECT 'relation', a || ' ' || b, count(*), count(DISTINCT doc_id) FROM rl GROUP BY a, b UNION ALL SELECT 'claim', hash, count(*), count(DISTINCT (doc_id, content)) FROM blocks WHERE length(content) >= 40 GROUP BY hash")
def updated_counts(spark, sf_dir) -> DataFrame:
    """Blocks and documents of each object, relation and claim (documents by spelling of a claim), in a store that was updated."""
    s = edited(spark, sf_dir)
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"), "blocks", "docs")
    rows = row(s.state("objects"), "object", F.col("name")).unionByName(row(s.state("relations"), "relation", F.concat_ws(" ", "source", "target")))
    return rows.unionByName(row(s.claims(), "claim", F.col("claim_id")))


@query(_AFTER + ", ol AS (SELECT DISTINCT md5(lower(c)) AS hash FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS c FROM documents WHERE doc_id % 9 <> 0) WHERE length(c) >= 40) SELECT 'lonely_object' AS kind, name AS key, 'in one document alone' AS reason FROM mentions GROUP BY name HAVING count(DISTINCT doc_id) = 1 UNION ALL SELECT 'orphan_claim', hash, 'no block left' FROM ol WHERE hash NOT IN (SELECT hash FROM blocks)")
def updated_queue(spark, sf_dir) -> DataFrame:
    """Items that are open in the review queue of a store that was updated."""
    return edited(spark, sf_dir).queue().where("status = 'open'").select("kind", "key", "reason")
