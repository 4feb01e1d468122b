"""Text operators: cleaning, tokens, chunks, gates, pages, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.plans.catalog import query
from notelode.plans.store import blocks, mentions, table
from notelode.plans.store import with_tables as W


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS n, 'document_' || substr(sha256(trim(regexp_replace(lang, '\\s+', ' ', 'g'), ' ') || chr(31) || trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), 1, 24) AS id FROM documents")
def stable_ids(spark, sf_dir) -> DataFrame:
    """Content-addressed ids over white-space-normalised parts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length(X.normalize_text("text")).alias("n"), X.stable_id("document", "lang", "text").alias("id"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(content, '```') THEN 'code' WHEN regexp_matches(content, '^\\|.*\\|$| \\| ') THEN 'table' WHEN regexp_matches(content, '^(?:[-*+]|[0-9]+[.)]) ') THEN 'list' WHEN starts_with(content, '>') THEN 'quote' WHEN regexp_matches(content, '^#{1,6} ') THEN 'heading' ELSE 'paragraph' END AS kind FROM (" + W("blocks") + "SELECT content FROM blocks)) GROUP BY kind")
def block_kinds(spark, sf_dir) -> DataFrame:
    return blocks(spark, sf_dir).groupBy(X.block_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 20")
def word_counts(spark, sf_dir) -> DataFrame:
    """Words of twenty documents or more; counted within documents first, so the shuffle carries one row a word and document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.words("text")).alias("word"))
    per = d.groupBy("word", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).where("docs >= 20")


@query("SELECT conv_id, count(*) AS kept, sum(length(t)) AS chars FROM (SELECT conv_id, substr(text, 1, 1200) AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def history_window(spark, sf_dir) -> DataFrame:
    """The last six messages of each conversation, cut to 1200 characters each."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 6")
    return c.groupBy("conv_id").agg(F.count("*").alias("kept"), F.sum(F.char_length(F.substring("text", 1, 1200))).alias("chars"))


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ') AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs FROM pages")
def page_outline(spark, sf_dir) -> DataFrame:
    """Title, links and paragraphs of each page."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), count('<a href="[^"]*"').alias("links"), count("(?i)<p[ >]").alias("paragraphs"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS text_md5 FROM pages")
def page_text(spark, sf_dir) -> DataFrame:
    """A digest of each page's visible text."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_text("html")).alias("text_md5"))


@query("WITH u AS (SELECT page_id, trim(url) AS raw, regexp_replace(trim(url), '#.*$', '') AS b FROM pages), x AS (SELECT *, regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)', 1) AS head, regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'spm')) AS ps FROM u), n AS (SELECT page_id, lower(CASE WHEN head = '' THEN raw ELSE head || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') END END) AS norm FROM x) SELECT norm, min(page_id) AS page_id, count(*) AS copies FROM n GROUP BY norm")
def url_dedup(spark, sf_dir) -> DataFrame:
    """The first page of each normalised url."""
    p = table(spark, sf_dir, "pages").select("page_id", X.normalize_url("url").alias("norm"))
    return p.groupBy("norm").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)) AS target FROM pages), t AS (SELECT DISTINCT lower(regexp_extract(title, '^([^ ]+)', 1)) AS name FROM (SELECT trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ') AS title FROM pages)) SELECT target, count(*) AS n FROM l WHERE lower(target) NOT IN (SELECT name FROM t WHERE name IS NOT NULL) GROUP BY target")
def broken_links(spark, sf_dir) -> DataFrame:
    """Link targets that are the first word of no page's title."""
    p = table(spark, sf_dir, "pages")
    names = p.select(F.lower(F.regexp_extract(F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), "^([^ ]+)", 1)).alias("name")).distinct()
    found = p.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    return found.join(names, F.lower("target") == F.col("name"), "left_anti")


@query("SELECT doc_id, length(body) AS n, CASE WHEN length(body) < 30 THEN 'short' WHEN bad > 0.02 THEN 'suspicious' ELSE 'ok' END AS verdict FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS body, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(regexp_replace(text, '\\s+', '', 'g')), 1) AS bad FROM documents)")
def conversion_gate(spark, sf_dir) -> DataFrame:
    """Whether a converted text is good enough: long enough, and few suspicious characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.char_length(F.regexp_replace("text", r"\s+", "")).alias("n"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("bad"))
    return d.select("doc_id", "n", F.when(F.col("n") < 30, "short").when(F.col("bad") / F.greatest("n", F.lit(1)) > 0.02, "suspicious").otherwise("ok").alias("verdict"))


@query(W("mentions") + "SELECT name, CASE WHEN length(name) > 14 THEN 'long' WHEN regexp_matches(name, 'ing$|tion$') THEN 'derived' WHEN regexp_matches(name, '(..)(..)') AND substr(name, 1, 2) = substr(name, 3, 2) THEN 'stutter' ELSE 'ok' END AS gate FROM (SELECT DISTINCT name FROM mentions)")
def name_gate(spark, sf_dir) -> DataFrame:
    """An ordered list of rules tells noise names from object names."""
    n = F.col("name")
    gate = F.when(F.char_length(n) > 14, "long").when(n.rlike("ing$|tion$"), "derived").when(F.substring(n, 1, 2) == F.substring(n, 3, 2), "stutter").otherwise("ok")
    return mentions(spark, sf_dir).select("name").distinct().select("name", gate.alias("gate"))


@query(W("blocks") + ", s AS (SELECT doc_id, ordinal, length(content) AS n, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM blocks), c AS (SELECT doc_id, (upto - n) // 1000 AS chunk, n FROM s) SELECT doc_id, chunk::bigint AS chunk, count(*) AS lines, sum(n) AS chars FROM c GROUP BY ALL")
def chunks(spark, sf_dir) -> DataFrame:
    """Lines packed into chunks by the thousand characters that precede them."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("content")
    b = blocks(spark, sf_dir).select("doc_id", n.alias("n"), F.sum(n).over(w).alias("upto"))
    return b.groupBy("doc_id", F.floor((F.col("upto") - F.col("n")) / 1000).alias("chunk")).agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


def greedy_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk, content: paragraphs packed in order into chunks of ``size`` characters at most, each beginning with
    the last ``overlap`` characters of the one before. Order-dependent, so each text is packed in Python within its row."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                now, k = "", 0
                for part in (text or "").split("\n"):
                    if now and len(now) + 1 + len(part) > size:
                        rows.append((doc_id, k, now))
                        now, k = now[-overlap:] if overlap else "", k + 1
                    now = f"{now}\n{part}" if now else part
                if now:
                    rows.append((doc_id, k, now))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, content string")
