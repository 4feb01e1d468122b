"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight; together the sources share ``share`` times all words, but no source takes more than ``cap``
times its own: what is over is shared again by weight. A source first takes its complete epochs (every document once
for each whole multiple of its size in the target). The rest of its target is drawn without replacement: a document's
key is an exponential variate divided by its quality weight, 1 / (1 + symbols for each word, 4 at most), so a document of
nothing but symbols still has a fifth of a clean one's weight; documents are taken in ascending key order, and the prefix
sums of their sizes are cut at the budget, so the last document may be taken in part.

The order within a source is never laid out in one task. Keys are dealt to buckets by their rank under the unit
exponential law; sums of buckets tell which bucket holds the cut, and only that bucket is sorted. Sources meet their
totals over salted keys.

Null and empty texts have size 0 and take 0. A null source is a source of its own, the last. Repeated rows count as
rows; which of equal rows holds the cut is of no effect. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.llm.base import DOC_COLUMNS, WORD, stored, table, with_row_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SALTS = 64
#: Documents of a source for each bucket of keys.
BUCKET_ROWS = 2000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, skey (the source; orders null last), size, key: one narrow row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    symbols = F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0))
    rows = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("skey"),
        size.alias("size"),
        symbols.alias("_n"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"),
    )
    quality = 1.0 / (1.0 + F.least(F.lit(4.0), F.col("_n") / F.greatest("size", F.lit(1))))
    u = (F.shiftrightunsigned("_h", 11) + 0.5) / float(1 << 53)
    return rows.select("doc_id", "skey", "size", quality.alias("quality"), (-F.log(u) / quality).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (skey, source_size, rows: a row for each source) with target.

    A target is the least of cap * source_size and level * weight, at the level that spends the whole budget. Sources
    in ascending order of cap * size / weight reach their caps first, so running sums tell which do.
    """
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("w", w).withColumn("full", cap * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("full") / F.col("w"), "skey")
    rows = rows.withColumn("budget", share * F.sum("source_size").over(every))
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("capped", (F.col("budget") - before) / rest >= F.col("full") / F.col("w"))
    spent = F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    level = F.when(F.col("capped"), F.col("full")).otherwise((F.col("budget") - spent) / free * F.col("w"))
    return rows.select("skey", "source_size", "rows", level.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken: a row for each document."""
    rows = stored(sized(docs, seed))
    sources = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = stored(
        sources.withColumn("epochs", epochs)
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS))
    )
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"]).drop("salt", "rows")
    rows = rows.withColumn("b", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)).drop("buckets")
    sums = rows.groupBy("skey", "b", "rest").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    cut = (
        sums.where("upto >= rest").groupBy("skey").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("before")), "b").alias("c"))
        .select("skey", F.col("c.b").alias("cut"), F.col("c.before").alias("before"))
    )
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SALTS)).cast("int")).join(cut, ["skey", "salt"], "left").drop("salt")
    rows = stored(rows)
    inside = F.col("b") == F.col("cut")
    whole = F.when(F.col("b") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
    w = Window.partitionBy("skey", "b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.where(inside).withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    part = part.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix"))).cast("long")).drop("prefix")
    done = part.unionByName(rows.where(~F.coalesce(inside, F.lit(False))).withColumn("part", whole))
    return done.select(
        "doc_id",
        F.when(F.col("skey").startswith("0"), F.substring("skey", 2, 1 << 30)).alias("source"),
        "size",
        "source_size",
        "target",
        F.col("epochs").cast("long").alias("epochs"),
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


def op7_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_stage(spark, docs, sf_dir) -> DataFrame:
    """Each document as often as the mix takes it; the part of the one at the cut is rounded to all or nothing. Documents are
    drawn by row, by a hash of doc_id and text: doc_ids may be null or repeated. Null and empty texts have no words and go.
    Rows that repeat a doc_id and text are each kept as often. An empty table gives an empty result; extra columns are left out."""
    rows = with_row_key(docs)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = mix(rows.select(F.col("_id").alias("doc_id"), "text", "source")).select(F.col("doc_id").alias("_id"), copies.alias("copies")).where("copies > 0")
    taken = taken.groupBy("_id").agg(F.max("copies").alias("copies"))
    again = rows.join(taken, "_id")
    return again.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*DOC_COLUMNS)
