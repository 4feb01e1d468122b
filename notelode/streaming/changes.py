"""Streams of changes: daily digests with late data, debounced bursts, and idempotent merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.plans.catalog import query
from notelode.plans.store import table


def read_changes(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of change events from Parquet files that arrive in a folder; ts becomes an event time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_digest(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes by day and kind; a stream keeps a day open until the watermark has passed it."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    days = changes.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n", "value")


def bursts(changes: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Debounced changes: a user's events with less than ``gap`` between them are one burst."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    b = changes.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return b.select("user_id", F.col("w.start").alias("began"), "n")


def once(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, though a source may deliver it again."""
    if changes.isStreaming:
        return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return changes.dropDuplicates(["event_id"])


BUCKETS = 64


def latest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The rows that merges into folder have kept so far (before batch ``below``): of each bucket the newest version."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(hadoop)] if store.exists(hadoop) else []
    versions = [n for n in names if n.startswith("v=") and (below is None or int(n[2:]) < below)]
    if not versions:
        return None
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in versions])
    newest = rows.groupBy("bucket").agg(F.max("v").alias("v"))  # folders alone tell; BUCKETS rows at most
    return rows.join(F.broadcast(newest), ["bucket", "v"]).drop("v")


def merge_into(folder: str, key: str = "event_id", order: str = "ts"):
    """A foreachBatch function that keeps the last version of each key, by ``order``, in snapshots below folder.

    Keys are dealt to BUCKETS; a batch writes only the buckets that it touches, as version ``number``, from the newest
    versions below it. So the same batch delivered again gives the same files, and numbers may have gaps.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        old = latest(spark, folder, number)
        if old is not None:
            new = old.join(new.select("bucket").distinct(), "bucket", "left_semi").unionByName(new)
        columns = [c for c in new.columns if c not in (key, "bucket")]
        last = new.groupBy(key, "bucket").agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*columns))).alias("r"))
        last.select(key, "r.*", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")

    return merge


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def change_digest(spark, sf_dir) -> DataFrame:
    """The batch twin of the daily digest stream."""
    d = daily_digest(table(spark, sf_dir, "events").withColumn("ts", F.to_timestamp_ntz(F.col("ts").cast("string"))))
    return d.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS bursts, count(*) AS n FROM s GROUP BY user_id")
def change_bursts(spark, sf_dir) -> DataFrame:
    """How many bursts of events each user has."""
    return bursts(_events(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("bursts"), F.sum("n").alias("n"))
