"""Pairs of sets that share a fixed number of names or more, without meeting all pairs of a frequent name.

Names of at most ``HOT`` sets are rare: sets that share one meet there, which makes at most HOT / 2 rows for each row of the input.
The other, hot names of a set are kept with it as a list. Pairs that share a rare name are completed from these lists, and only
if their numbers of hot names can make up what is missing. Pairs that share hot names alone share three of them: sets with at
most ``LIGHT`` hot names meet at triples of these, so only true pairs do; the few heavier ones are counted against all sets
of their names. What meets grows with the rows and with the result, not with the square of a name's sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.plans.checkpoints import stored

HOT, LIGHT, NEED = 64, 24, 3


def triples(names) -> Column:
    """A hash of each three of the sorted names."""
    n = F.size(names)
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    third = lambda i, j: F.transform(upto(j + 1, n), lambda k: F.xxhash64(F.element_at(names, i), F.element_at(names, j), F.element_at(names, k)))
    second = lambda i: F.flatten(F.transform(upto(i + 1, n - 1), lambda j: third(i, j)))
    return F.flatten(F.transform(upto(F.lit(1), n - 2), second))


def pairs_of(rows: DataFrame, by: str, other: DataFrame | None = None) -> DataFrame:
    """doc_a < doc_b and the columns of either side, for each value of by that they share."""
    side = lambda df, k: df.select(by, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != by])
    if other is None:
        return side(rows, "a").join(side(rows, "b"), by).where("doc_id_a < doc_id_b")
    met = side(rows, "x").join(side(other, "y"), by).where("doc_id_x <> doc_id_y")
    return met.select(by, F.least("doc_id_x", "doc_id_y").alias("doc_id_a"), F.greatest("doc_id_x", "doc_id_y").alias("doc_id_b")).distinct()


def sharing(sets: DataFrame, hot: int = HOT, light: int = LIGHT) -> DataFrame:
    """doc_a, doc_b, shared: the pairs of sets (doc_id, name, df: the sets that have the name; different rows) that share three names
    or more."""
    own = stored(sets.where(F.col("df") > hot).groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names")))  # of one document
    sizes = own.select("doc_id", F.size("names").alias("h"))
    rare = sets.where(F.col("df") <= hot).select("doc_id", "name").join(sizes, "doc_id", "left").select("doc_id", "name", F.coalesce("h", F.lit(0)).alias("h"))
    met = pairs_of(rare, "name").groupBy("doc_id_a", "doc_id_b").agg(F.count("*").alias("rare"), F.least(F.first("h_a"), F.first("h_b")).alias("more"))
    by_rare = met.where(F.col("rare") + F.col("more") >= NEED).select("doc_id_a", "doc_id_b", "rare")
    lights, heavies = (own.where(x) for x in (F.size("names").between(NEED, light), F.size("names") > light))
    by_three = pairs_of(lights.select("doc_id", F.explode(triples(F.col("names"))).alias("key")), "key").select("doc_id_a", "doc_id_b")
    each = lambda df: df.select("doc_id", F.explode("names").alias("name"))
    by_count = pairs_of(each(heavies), "name", each(own.where(F.size("names") >= NEED))).groupBy("doc_id_a", "doc_id_b").agg(F.count("*").alias("n")).where(F.col("n") >= NEED)
    # a pair that meets in several ways is one; without a rare name in common it has none
    found = by_rare.unionByName(by_three.unionByName(by_count.select("doc_id_a", "doc_id_b")).withColumn("rare", F.lit(0).cast("long")))
    found = stored(found.groupBy("doc_id_a", "doc_id_b").agg(F.max("rare").alias("rare")))
    plain = found.join(own.select(F.col("doc_id").alias("doc_id_a"), F.col("names").alias("na")), "doc_id_a", "left").join(own.select(F.col("doc_id").alias("doc_id_b"), F.col("names").alias("nb")), "doc_id_b", "left")
    common = F.coalesce(F.size(F.array_intersect("na", "nb")), F.lit(0))
    return plain.select(F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), (F.col("rare") + F.when(F.col("na").isNull() | F.col("nb").isNull(), 0).otherwise(common)).alias("shared")).where(F.col("shared") >= NEED)
