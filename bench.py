"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "top_objects", "object_counts", "claim_snapshot", "latest_verdicts", "weighted_cooccurrence", "semantic_shares", "claim_conflicts", "repeated_short_lines",
    "change_counts", "change_bursts", "latest_order", "brand_revenue", "word_counts", "page_text", "chunks", "bm25_top10", "global_idf", "dense_top6",
    "link_dedup", "manifest_diff", "protected_upsert", "topic_fit", "note_groups", "hybrid_top10", "inverted_index", "relation_edges", "polarity_conflicts",
    "pending_inbox", "replaced_documents", "verified_quotes",
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def laid_out(spark, sf_dir: str, folder: str, parts: int) -> str:
    """The tables again, in files of about equal size: as given each is one row group, which one core reads alone."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    from pyspark.sql import SparkSession

    from notelode import all_queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        # one small file is one split by default; smaller ones use all cores
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    began = time.perf_counter()
    tables = laid_out(spark, sf_dir, f"{scratch}/tables", int(cpus))
    layout = round(time.perf_counter() - began, 3)  # once, and part of the total
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):  # the second run is warm
            began = time.perf_counter()
            queries[name](spark, tables).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(layout + sum(seconds.values()), 3), "unit": "sec", "layout_sec": layout, "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
