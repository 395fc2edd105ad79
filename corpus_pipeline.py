"""A training-data pipeline over ``documents``: each stage reads what the stage
before it kept, written as Parquet in the cluster's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vantage.llm import decontam, mixing, neardup, quality, tokens
from vantage.session import ensure_checkpoint_dir, shared_path

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID / binary output", tokens.stage),
]

#: Trained models and tokenizers are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: where each document's ids lie in the token files."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
