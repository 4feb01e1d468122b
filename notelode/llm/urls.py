"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for all other URLs.

The trees are trained from labelled URLs: a table of (url, label: 0 allow, 1 block), or else those that a rule decides; at
most about ``train_rows`` of them, half of either kind, chosen by hash. Features: lengths, depth, digit ratio, character
entropy, counts of parameters and of special characters, and statistics of the host's suffix (its last label) over all
labelled URLs; a training row's own label is left out of its suffix's rate. Only DataFrame functions and Spark ML's JVM
trees are used. The ``suffixes`` most frequent suffixes are broadcast, the others are met by a merge join; a suffix
without labels has the overall rate.

A null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees on its (empty)
features. With labels of one kind only, the method's verdict is that kind; without any, allow. Repeated rows are judged
alike, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import stored, table

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TRAIN_ROWS = 20_000
SUFFIXES = 1000
FEATURES = ("n_url", "n_host", "n_path", "n_query", "depth", "labels", "digits", "entropy", "params", "marks", "suffix_rate", "suffix_share")


def host_and_path(url) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), ascii_uppercase, ascii_lowercase), found(2)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and decided (allow, block or null) by the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = decided = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, decided = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    return rows.withColumns({"rule": rule, "decided": decided})


def entropy(text: str) -> Column:
    """Bits a character, over the characters of the column."""
    chars, n = F.split(text, ""), F.greatest(F.char_length(text), F.lit(1))
    one = lambda s, c: s - F.when(c == "", 0.0).otherwise(F.size(F.filter(F.split(text, ""), lambda x: x == c)) / n * F.log2(F.size(F.filter(F.split(text, ""), lambda x: x == c)) / n))
    return F.coalesce(F.aggregate(F.array_distinct(chars), F.lit(0.0), one), F.lit(0.0))


def lexical(rows: DataFrame, stats: tuple[DataFrame, DataFrame], rate: float, own: Column | None = None) -> DataFrame:
    """rows with a vector of FEATURES; stats: suffix, n, k, share of frequent suffixes and of the others; own: the label of a
    row that is among those counted."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = lambda x: F.char_length(x).cast("double")
    rows = rows.withColumns({
        "_u": url,
        "suffix": F.substring_index("host", ".", -1),
        "n_url": size(url), "n_host": size("host"), "n_path": size("path"), "n_query": size(query),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.char_length(url), F.lit(1)),
        "params": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
        "marks": F.regexp_count(url, F.lit(r"[-_%~.#@]")).cast("double"),
    })
    often, rare = stats
    rows = rows.withColumn("entropy", entropy("_u")).join(F.broadcast(often), "suffix", "left")
    # rows of frequent suffixes are spread over keys that no suffix has
    key = F.when(F.col("n").isNotNull(), F.concat(F.lit("/"), F.pmod(F.xxhash64("_u"), F.lit(1000)))).otherwise(F.col("suffix"))
    rest = rare.select(F.col("suffix").alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("n", "k", "share")))
    rows = rows.withColumn("_key", key).hint("merge").join(rest, "_key", "left")
    n, k, share = (F.coalesce(c, f"_{c}", F.lit(0.0)) for c in ("n", "k", "share"))
    less = F.lit(0.0) if own is None else F.lit(1.0)
    rows = rows.withColumn("suffix_rate", (k - (F.lit(0.0) if own is None else own) + 10 * rate) / (n - less + 10)).withColumn("suffix_share", share)
    rows = rows.drop("_u", "_key", "_n", "_k", "_share", "n", "k", "share")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def suffix_statistics(labelled: DataFrame, total: int, most: int) -> tuple[DataFrame, DataFrame]:
    """suffix, n, k (of them blocked), share: the ``most`` most frequent suffixes, and all others."""
    got = labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("k"))
    got = stored(got.withColumn("share", F.col("n") / max(total, 1)))
    often = stored(got.orderBy(F.desc("n"), "suffix").limit(most))
    return often, got.join(F.broadcast(often.select("suffix")), "suffix", "left_anti")


def trained(labelled: DataFrame, n: int, k: float, train_rows: int, suffixes: int):
    """The trees and the suffix statistics, from labelled (url, host, path, label); n rows of which k are blocked."""
    rate = k / n
    stats = suffix_statistics(labelled, n, suffixes)
    draw = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1_000_000))  # half of the rows, at most, from either kind
    chosen = draw < F.when(F.col("label") == 1, 5e5 * train_rows / k).otherwise(5e5 * train_rows / (n - k))
    train = stored(lexical(labelled.where(chosen), stats, rate, F.col("label")).select("features", "label"))
    return GBTClassifier(maxIter=15, maxDepth=4, maxBins=32, seed=7, cacheNodeIds=False).fit(train), stats


def with_label(urls: DataFrame) -> DataFrame:
    """url, host, path, label from a table of (url, label)."""
    host, path = host_and_path(F.col("url"))
    return urls.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))


def counts(labelled: DataFrame) -> tuple[int, float]:
    seen = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("k")).first()
    return seen.n, seen.k


def held_out_figures(urls: DataFrame, train_rows: int = TRAIN_ROWS, suffixes: int = SUFFIXES) -> dict[str, float]:
    """Of a table of (url, label): precision and recall of block on a fifth by hash, trained on the rest."""
    out = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(5)) == 0
    labelled = with_label(urls)
    n, k = counts(labelled.where(~out))
    model, stats = trained(labelled.where(~out), n, k, train_rows, suffixes)
    got = model.transform(lexical(labelled.where(out), stats, k / n))
    hit = lambda label, said: F.coalesce(F.sum(((F.col("label") == label) & (F.col("prediction") == said)).cast("int")), F.lit(0))
    x = got.agg(hit(1, 1), hit(0, 1), hit(1, 0)).first()
    return {"precision": x[0] / max(1, x[0] + x[1]), "recall": x[0] / max(1, x[0] + x[2])}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS, suffixes: int = SUFFIXES, urls: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null without trees); urls: labelled ones."""
    rows = ruled(pages, rules)
    decided = rows.where("decided is not null").select("url", "host", "path", (F.col("decided") == "block").cast("double").alias("label"))
    labelled = decided if urls is None else with_label(urls)
    n, k = counts(labelled)
    out = ["page_id", "host", "path", "rule"]
    if not 0 < k < n:
        return rows.select(*out, F.coalesce("decided", F.lit("block" if n and k else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model, stats = trained(labelled, n, k, train_rows, suffixes)
    scored = model.transform(lexical(rows, stats, k / n))
    method = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    p = F.element_at(vector_to_array("probability"), 2)
    return scored.select(*out, F.coalesce("decided", method).alias("verdict"), F.round(p, 6).alias("score"))


def op5_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
