"""Cut lineage through a table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share; where that is unset, a temporary one
    in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/notelode-checkpoints"
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
