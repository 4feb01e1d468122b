"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

A text's words, its pairs of neighbouring words and its words' last characters (a junk suffix shows there) are hashed
into ``buckets`` bins. Two multinomials over the bins, one from the trusted documents, one from all documents, give each
bin a log ratio; a document's score is the mean ratio of its n-grams. A document is kept if it passes the base rules
and its score reaches the target documents' mean less ``sigmas`` standard deviations, or less ``margin`` where that is more. Only DataFrame
functions are used; the ``buckets`` ratios are the only thing that goes through the driver.

Null and empty texts: no words, base_failed, score 0. Texts without n-grams score 0. Equal texts get equal values. An
empty table gives an empty result; each row gives a row, repeated ones too. Without any trusted document nothing is known of
the target: the bins' ratios are 0, and the base rules alone decide. Only doc_id and text are read; extra columns are
ignored. The last characters of words were chosen since junk suffixes show there; on text without such junk they add a
weak letter profile to the score and no more.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import DOC_COLUMNS, GAP, WORD, stored, table, with_row_key

BUCKETS = 1 << 14
SIGMAS = 4.0
#: At least so far below the target documents' mean lies the threshold, in nats a gram.
MARGIN = 0.3
SYMBOLS = r"[#*$%&|<>]"


def with_words(docs: DataFrame) -> DataFrame:
    """The rows of docs with _w, the words of the whole text."""
    w = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), GAP)
    return docs.withColumn("_w", F.when(F.col("text").rlike(WORD), w).otherwise(F.array().cast("array<string>")))


def base_columns() -> list[Column]:
    """Four counts of the base rules over the columns text and _w."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    return [
        F.size("_w").cast("long").alias("n_words"),
        count(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        count(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    ]


def tail(array: str, k: int) -> Column:
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def repeat_words(seen: DataFrame) -> DataFrame:
    """seen with n_repeat_words, without any shuffle: only texts that hold a 3-word window twice sort their windows."""
    seen = seen.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    seen = seen.withColumn("_h2", F.zip_with("_h", tail("_h", 1), lambda x, y: F.xxhash64(x, y)))
    seen = seen.withColumn("_x", F.zip_with("_h2", tail("_h", 2), lambda x, y: F.xxhash64(x, y)))
    seen = seen.withColumn("_x", F.slice("_x", F.lit(1), F.greatest(F.size("_x") - 2, F.lit(0))))
    twice = F.size(F.array_distinct("_x")) < F.size("_x")
    seen = seen.withColumn("_s", F.when(twice, F.sort_array(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.zip_with("_s", tail("_s", 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)))
    seen = seen.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    # a window adds as many words as lie beyond the one before it
    added = F.zip_with("_p", tail("_p", 1), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    total = F.aggregate(added, F.lit(0).cast("long"), lambda n, x: n + x)
    return seen.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_h", "_h2", "_x", "_s", "_p")


def by_gram(seen: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """The columns keep of seen once for each word, with the bins of the word, of it and the next, and of its last character.

    A row without words stays as one row without bins.
    """
    pairs = F.arrays_zip(F.col("_w").alias("a"), tail("_w", 1).alias("b"))
    rows = seen.select(*keep, F.explode_outer(pairs).alias("z"))
    a, b = F.col("z").getField("a"), F.col("z").getField("b")
    into = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return rows.select(
        *keep,
        F.when(a.isNotNull(), into(F.xxhash64(a))).alias("g1"),
        F.when(b.isNotNull(), into(F.xxhash64(a, b))).alias("g2"),
        F.when(a.isNotNull(), into(F.xxhash64(F.right(a, F.lit(1)), F.lit(1)))).alias("g3"),
    )


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """For each bin the log of target share over raw share, add-one smoothed: ``buckets`` numbers from all documents."""
    # by merge at any size: labels grow with the documents
    marked = docs.select("doc_id", "text").hint("merge").join(trusted.select("doc_id").distinct().withColumn("_q", F.lit(1)), "doc_id", "left")
    marked = with_words(marked.select("text", F.coalesce("_q", F.lit(0)).alias("_q")))
    rows = (
        by_gram(marked, buckets, "_q")
        .select("_q", F.explode(F.array("g1", "g2", "g3")).alias("bucket")).where("bucket is not null")
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_q").alias("target"))
        .collect()
    )
    n, m = sum(r.raw for r in rows), sum(r.target for r in rows)
    out = [math.log((n + buckets) / (m + buckets)) if m else 0.0] * buckets
    for r in rows if m else []:
        out[r.bucket] = math.log((r.target + 1) / (m + buckets)) - math.log((r.raw + 1) / (n + buckets))
    return [round(x, 6) for x in out]


def measured(docs: DataFrame, ratios: list[float], ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ids, the base counts and llr: the mean log ratio of a document's n-grams, 0 without any.

    All n-grams of a row are made and summed in one task; one narrow row of it goes to the shuffle. The ratios are one
    folded constant.
    """
    columns = [*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keys = [*columns, "_row"]  # rows stay apart, whatever else they share
    seen = repeat_words(with_words(docs.select(*ids, "text", F.monotonically_increasing_id().alias("_row")))).select(*ids, "_row", "_w", *base_columns(), "n_repeat_words")
    by_bin = F.from_json(F.lit(json.dumps([round(1e6 * x) for x in ratios])), "array<long>")
    value = lambda g: F.coalesce(F.get(by_bin, F.col(g)), F.lit(0).cast("long"))
    rows = by_gram(seen, len(ratios), *keys).select(*keys, (value("g1") + value("g2") + value("g3")).alias("v"))
    grams = F.greatest(3 * F.col("n_words") - 1, F.lit(1)) / F.greatest("n_words", F.lit(1))  # for each word
    return rows.groupBy(*keys).agg(F.avg("v").alias("v")).select(*columns, F.round(F.col("v") / grams / 1e6, 6).alias("llr"))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, sigmas: float = SIGMAS, margin: float = MARGIN, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ids, the base counts, base_failed, llr, threshold, kept: a row for each document. ids, of which doc_id is
    one, must tell different texts apart."""
    ratios = bucket_ratios(docs, trusted, buckets)
    seen = stored(measured(docs, ratios, ids))
    limit = seen.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").agg(
        F.round(F.avg("llr") - F.greatest(sigmas * F.stddev_pop("llr"), F.lit(margin)), 6).alias("threshold")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        seen.crossJoin(F.broadcast(limit))  # one row
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("llr") >= F.coalesce("threshold", F.lit(float("-inf")))))
    )


def trusted_docs(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op1_quality_llr(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted_docs(table(spark, sf_dir, "labels")))


def quality_stage(spark, docs, sf_dir) -> DataFrame:
    """The documents that the rules keep, by row: doc_ids may be null or repeated, repeated rows stay repeated, null and empty
    texts go (they have no words). An empty table gives an empty result; extra columns are left out."""
    rows = with_row_key(docs)
    good = judge(rows, trusted_docs(table(spark, sf_dir, "labels")), ids=("doc_id", "_id")).where("kept").select("_id")
    return rows.join(good, "_id", "left_semi").select(*DOC_COLUMNS)
