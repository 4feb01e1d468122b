"""Link and change maintenance: dedup, backlinks, statistics, manifest diffs, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.plans.catalog import query
from notelode.plans.store import links, notes, objects, table
from notelode.plans.store import with_tables as W

_DEDUP = ", d AS (SELECT src, dst, status, weight, pos FROM links WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END, pos, weight) = 1)"


def deduped(spark, sf_dir) -> DataFrame:
    """The first link of each pair, a confirmed one before others; self links go."""
    l = links(spark, sf_dir).where("src <> dst")  # noqa: E741
    rank = F.struct(F.when(F.col("status") == "confirmed", 0).otherwise(1), "pos", "weight")
    best = l.groupBy("src", "dst").agg(F.min_by(F.struct("status", "weight", "pos"), rank).alias("b"))
    return best.select("src", "dst", "b.*")


@query(W("links") + _DEDUP + " SELECT * FROM d")
def link_dedup(spark, sf_dir) -> DataFrame:
    return deduped(spark, sf_dir)


@query(W("links") + _DEDUP + " SELECT status, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d b WHERE b.src = d.dst AND b.dst = d.src)) AS mutual FROM d GROUP BY status")
def link_stats(spark, sf_dir) -> DataFrame:
    """Links by status, and how many have a link back."""
    d = deduped(spark, sf_dir).select("src", "dst", "status")
    back = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
    return d.join(back, ["src", "dst"], "left").groupBy("status").agg(F.count("*").alias("n"), F.count("mutual").alias("mutual"))


@query(W("links") + _DEDUP + ", n AS (SELECT src AS item, dst AS other FROM d WHERE status = 'confirmed' UNION SELECT dst, src FROM d WHERE status = 'confirmed') SELECT item, count(*) AS neighbours, min(other) AS first FROM n GROUP BY item")
def neighbours(spark, sf_dir) -> DataFrame:
    """Items one confirmed link away, in either direction."""
    d = deduped(spark, sf_dir).where("status = 'confirmed'")
    n = d.selectExpr("src as item", "dst as other").union(d.selectExpr("dst", "src")).distinct()
    return n.groupBy("item").agg(F.count("*").alias("neighbours"), F.min("other").alias("first"))


@query(W("links") + ", w AS (SELECT src, dst, count(*) AS n, round(avg(weight), 4) AS mean FROM links WHERE src <> dst GROUP BY ALL) SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(n) AS links, max(mean) AS best FROM w GROUP BY ALL")
def edge_rollup(spark, sf_dir) -> DataFrame:
    """Directed links rolled up to undirected edges."""
    w = links(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean"))
    return w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("links"), F.max("mean").alias("best"))


_OLD = "(SELECT path, md5(body) AS hash FROM notes WHERE doc_id % 7 <> 0)"
_NEW = "(SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN body || '!' ELSE body END) AS hash FROM notes WHERE doc_id % 11 <> 0)"


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: how each path of two manifests (path, hash) changed."""
    both = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


@query(W("notes") + f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.path = n.path")
def manifest_diff(spark, sf_dir) -> DataFrame:
    """Two snapshots of the notes compared by content hash."""
    n = notes(spark, sf_dir)
    old = n.where("doc_id % 7 <> 0").select("path", F.md5("body").alias("hash"))
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return diff(old, n.where("doc_id % 11 <> 0").select("path", F.md5(edited).alias("hash")))


def upsert(old: DataFrame, new: DataFrame, key: str, edited: str, keep: list[str]) -> DataFrame:
    """old and new merged by key: new values win, but rows that a user edited keep the columns ``keep``."""
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = []
    for c in old.columns:
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        out.append((F.when(F.coalesce(F.col(f"a.{edited}"), F.lit(False)), o).otherwise(F.coalesce(n, o)) if c in keep else F.coalesce(n, o)).alias(c))
    return rows.select(*out)


@query(W("objects") + ", a AS (SELECT name, confidence, confidence > 0.5 AS user_edited FROM objects WHERE length(name) % 3 <> 0), b AS (SELECT name, round(1 - confidence, 2) AS confidence, false AS user_edited FROM objects WHERE length(name) % 3 <> 1) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.user_edited THEN a.confidence ELSE coalesce(b.confidence, a.confidence) END AS confidence, CASE WHEN a.user_edited THEN a.user_edited ELSE coalesce(b.user_edited, a.user_edited) END AS user_edited FROM a FULL JOIN b ON a.name = b.name")
def protected_upsert(spark, sf_dir) -> DataFrame:
    """An upsert that leaves user-edited rows as they are."""
    o = objects(spark, sf_dir).select("name", "confidence")
    old = o.where("length(name) % 3 <> 0").withColumn("user_edited", F.col("confidence") > 0.5)
    new = o.where("length(name) % 3 <> 1").select("name", F.round(1 - F.col("confidence"), 2).alias("confidence"), F.lit(False).alias("user_edited"))
    return upsert(old, new, "name", "user_edited", ["confidence", "user_edited"])


@query("SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS idle FROM customer GROUP BY c_mktsegment")
def idle_customers(spark, sf_dir) -> DataFrame:
    """Parents without children by group: an anti join at scale."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    busy = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("busy", F.lit(True))
    return c.join(busy, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count_if(F.col("busy").isNull()).alias("idle"))


@query("SELECT p_brand, o_orderpriority, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def brand_revenue(spark, sf_dir) -> DataFrame:
    """A three-way join with sums: the store's mention joins at scale."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return li.join(p, "l_partkey").join(o, "l_orderkey").groupBy("p_brand", "o_orderpriority").agg(F.count("*").alias("items"), revenue.alias("revenue"))
