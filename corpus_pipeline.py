"""A training-data pipeline over documents: STAGES in order, each stored as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelode.llm import mixing, neardup, pieces, quality, secrets
from notelode.llm.base import Scratch

#: (name, function of (spark, docs, sf_dir)); all but the last give the columns of documents.
STAGES = [
    ("quality_rules", quality.quality_stage),
    ("minhash_neardup", neardup.neardup_stage),
    ("secret_scan", secrets.secrets_stage),
    ("source_mixing", mixing.mixing_stage),
    ("sentencepiece", pieces.pieces_stage),
]

#: Hashes, trees and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read, docs = docs, scratch.stored(stage(spark, docs, sf_dir))
        scratch.drop(read)  # if it is one of these tables
    return STAGES[-1][1](spark, docs, sf_dir)
