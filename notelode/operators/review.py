"""Review queues and gates: quality issues, an inbox of several sources, conflicts that survive review, url and query gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.functions import text as X
from notelode.operators.semantic import _PRINTS, _SIDES, claim_conflicts
from notelode.plans.catalog import query
from notelode.plans.store import claims, evidence, mentions, objects, table
from notelode.plans.store import with_tables as W

_ISSUES = """, i AS (SELECT 'orphan_claim' AS rule, claim_id AS item FROM claims c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.status = 'active')
UNION ALL SELECT 'weak_claim', claim_id FROM claims WHERE status = 'active' AND confidence < 0.1
UNION ALL SELECT 'long_claim', claim_id FROM claims WHERE length(statement) > 600
UNION ALL SELECT 'unused_object', name FROM objects o WHERE status = 'inactive' AND confidence < 0.5
UNION ALL SELECT 'rare_object', name FROM (SELECT name, count(*) AS n FROM mentions GROUP BY name) WHERE n = 1 AND length(name) > 14)"""


def issues(spark, sf_dir) -> DataFrame:
    """rule, item: what five quality rules find; each rule is a plan of its own."""
    c, o = claims(spark, sf_dir), objects(spark, sf_dir)
    rare = mentions(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).where("n = 1 and length(name) > 14")
    rules = {
        "orphan_claim": c.join(evidence(spark, sf_dir).where("status = 'active'"), "claim_id", "left_anti").select("claim_id"),
        "weak_claim": c.where("status = 'active' and confidence < 0.1").select("claim_id"),
        "long_claim": c.where(F.char_length("statement") > 600).select("claim_id"),
        "unused_object": o.where("status = 'inactive' and confidence < 0.5").select("name"),
        "rare_object": rare.select("name"),
    }
    return reduce(DataFrame.union, [df.select(F.lit(rule).alias("rule"), F.col(df.columns[0]).alias("item")) for rule, df in rules.items()])


@query(W("claims", "evidence", "objects") + _ISSUES + " SELECT rule, item FROM i")
def quality_issues(spark, sf_dir) -> DataFrame:
    return issues(spark, sf_dir)


@query(W("claims", "evidence", "objects") + _ISSUES + " SELECT rule, count(*) AS n FROM i GROUP BY rule")
def issue_counts(spark, sf_dir) -> DataFrame:
    """Pending issues by rule."""
    return issues(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


@query(W("claims", "evidence", "objects") + _ISSUES + " SELECT rule, item, CASE WHEN rule LIKE '%claim' THEN 1 ELSE 2 END AS priority FROM i ORDER BY priority, rule, item LIMIT 100")
def inbox_page(spark, sf_dir) -> DataFrame:
    """The first hundred pending items, by priority."""
    priority = F.when(F.col("rule").like("%claim"), 1).otherwise(2)
    return issues(spark, sf_dir).withColumn("priority", priority).orderBy("priority", "rule", "item").limit(100)


def keep_reviewed(found: DataFrame, queue: DataFrame) -> DataFrame:
    """found (id, fingerprint) with status: what was reviewed stays so while its fingerprint is the same."""
    old = queue.select("id", F.col("fingerprint").alias("old"), F.col("status").alias("was"))
    status = F.when((F.col("old") == F.col("fingerprint")) & (F.col("was") == "reviewed"), "reviewed").otherwise("pending")
    return found.join(old, "id", "left").select("id", "fingerprint", status.alias("status"))


@query(_SIDES + ", r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject, topic, direction ORDER BY claim_id) <= 10), f AS (SELECT DISTINCT least(a.claim_id, b.claim_id) || '|' || greatest(a.claim_id, b.claim_id) AS id, md5(least(a.claim_id, b.claim_id) || greatest(a.claim_id, b.claim_id)) AS fingerprint FROM r a JOIN r b ON a.subject = b.subject AND a.topic = b.topic WHERE a.direction = 'up' AND b.direction = 'down') SELECT id, fingerprint, CASE WHEN ('0x' || substr(fingerprint, 1, 2))::int % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS status FROM f")
def conflict_queue(spark, sf_dir) -> DataFrame:
    """Conflicts, against a queue in which a third is reviewed, a third is reviewed in another form, and a third is new."""
    found = claim_conflicts(spark, sf_dir).select(F.concat_ws("|", "claim_a", "claim_b").alias("id"), F.md5(F.concat("claim_a", "claim_b")).alias("fingerprint")).distinct()
    third = F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int") % 3
    queue = found.where(third < 2).select("id", F.when(third == 0, F.col("fingerprint")).otherwise("older").alias("fingerprint"), F.lit("reviewed").alias("status"))
    return keep_reviewed(found, queue)


# What is no address of the public internet.
HOST = r"(?i)^https?://(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/?#:]*)"
LOCAL_NAME = r"^$|[\s\\%]|(^|\.)(localhost|local|internal)\.?$"
NUMBER = r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"
QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
RESERVED = r"^(0|10|127|2[234][0-9]|25[0-5])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
PUBLIC_SIX = r"^\[[23][0-9a-f]{3}:[0-9a-f:.]*\]$"


def host_of(url) -> Column:
    """The host of a web address, in lower case, without user, password and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def safe_url(url) -> Column:
    """Whether a url may be fetched: http only, and no local name, no private or reserved address, and none in a spelling other
    than four decimal numbers or a global IPv6 address. A null url may not."""
    host = host_of(url)
    number = host.rlike(NUMBER)
    fine = F.when(host.startswith("["), host.rlike(PUBLIC_SIX)).when(number, host.rlike(QUAD) & ~host.rlike(RESERVED)).otherwise(~host.rlike(LOCAL_NAME))
    return F.coalesce(url.rlike("(?i)^https?://") & fine, F.lit(False))


_HOST_SQL = f"lower(regexp_extract(url, '{HOST}', 1))"


@query(f"SELECT page_id, host, coalesce(regexp_matches(url, '(?i)^https?://') AND CASE WHEN starts_with(host, '[') THEN regexp_matches(host, '{PUBLIC_SIX}') WHEN regexp_matches(host, '{NUMBER}') THEN regexp_matches(host, '{QUAD}') AND NOT regexp_matches(host, '{RESERVED}') ELSE NOT regexp_matches(host, '{LOCAL_NAME}') END, false) AS safe FROM (SELECT page_id, url, {_HOST_SQL} AS host FROM pages)")
def url_safety(spark, sf_dir) -> DataFrame:
    """Which pages' urls may be fetched."""
    return table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), safe_url(F.col("url")).alias("safe"))


@query("SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'easy' WHEN length(text) > 200 OR length(text) - length(replace(text, '?', '')) >= 2 THEN 'broad' ELSE 'medium' END AS complexity FROM conversations WHERE role = 'user'")
def query_complexity(spark, sf_dir) -> DataFrame:
    """How broad a user's question is."""
    t = F.col("text")
    marks = F.char_length(t) - F.char_length(F.replace(t, F.lit("?"), F.lit("")))
    kind = F.when(F.char_length(t) < 20, "easy").when((F.char_length(t) > 200) | (marks >= 2), "broad").otherwise("medium")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("complexity"))


@query("SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS best, CASE WHEN count(*) >= 15 THEN 'broad' WHEN max(o_totalprice) > 400000 THEN 'focused' WHEN count(*) <= 3 THEN 'weak' ELSE 'balanced' END AS quality FROM orders GROUP BY o_custkey")
def citation_quality(spark, sf_dir) -> DataFrame:
    """Groups put into buckets by their number and best score."""
    n, best = F.count("*"), F.max("o_totalprice")
    quality = F.when(n >= 15, "broad").when(best > 400000, "focused").when(n <= 3, "weak").otherwise("balanced")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("n"), F.round(best, 2).alias("best"), quality.alias("quality"))


@query("SELECT o_custkey, count(*) AS stale FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderdate < shipped - INTERVAL 60 DAY GROUP BY o_custkey")
def stale_parents(spark, sf_dir) -> DataFrame:
    """Parents older than their newest child by more than 60 days: stale surveys, at scale."""
    new = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.join(new, o.o_orderkey == new.l_orderkey).where("o_orderdate < shipped - interval 60 days").groupBy("o_custkey").agg(F.count("*").alias("stale"))


@query(_PRINTS + ", m AS (SELECT name, fingerprint, kind FROM f) SELECT a.fingerprint, count(*) AS pairs, min(a.name) AS first_entity, min(b.name) AS first_concept FROM m a JOIN m b ON a.fingerprint = b.fingerprint WHERE a.kind = 'entity' AND b.kind = 'concept' GROUP BY a.fingerprint")
def cross_kind_pairs(spark, sf_dir) -> DataFrame:
    """Entities and concepts of one fingerprint: counted from the two sides' counts, so no pairs are made."""
    o = objects(spark, sf_dir).withColumn("fingerprint", X.name_fingerprint("name"))
    side = lambda kind: o.where(F.col("kind") == kind).groupBy("fingerprint").agg(F.count("*").alias(f"n_{kind}"), F.min("name").alias(f"first_{kind}"))
    both = side("entity").join(side("concept"), "fingerprint")
    return both.select("fingerprint", (F.col("n_entity") * F.col("n_concept")).alias("pairs"), "first_entity", "first_concept")
