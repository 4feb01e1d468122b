"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Characters of text that a Python worker takes up at a time, about.
PART_CHARS = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame) -> DataFrame:
    """The columns of documents and _id, a hash of doc_id and text: doc_ids may be null, or be shared by different texts.

    Rows of one doc_id and text have one _id (a null text is an empty one). It has 64 bits; two of 15 million documents
    share one by chance in about six of a million tables.
    """
    return docs.select(*DOC_COLUMNS, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_id"))


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def in_parts(batches: Iterator[pd.DataFrame], chars: int = PART_CHARS, column: str = "text") -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in parts of about so many characters, however large a batch the session sends."""
    for b in batches:
        begin = size = 0
        for k, x in enumerate(b[column].tolist()):
            size += len(x or "")
            if size >= chars:
                yield b.iloc[begin : k + 1].reset_index(drop=True)
                begin, size = k + 1, 0
        if begin < len(b) or not len(b):
            yield b.iloc[begin:].reset_index(drop=True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share, spark.checkpoint.dir.

    Where that is unset, a temporary folder serves in local mode, as in tests; on a cluster it is an error, since each
    executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/notelode-checkpoints"
    return f"{root.rstrip('/')}/notelode-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one run, below a new folder of the shared one; each can be dropped when nothing reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, shared_dir(spark), []

    def stored(self, df: DataFrame) -> DataFrame:
        """Cut the lineage: write df as Parquet and read it again."""
        path = f"{self.root}/{len(self.tables)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables; nothing that is still to run may read them."""
        hadoop, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        for own, path in self.tables:
            if any(own is x for x in tables):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(hadoop).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """One intermediate table that the result reads, so it stays."""
    return Scratch(df.sparkSession).stored(df)


def words(text) -> F.Column:
    """The words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))
