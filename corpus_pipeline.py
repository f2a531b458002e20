"""The corpus pipeline: stages over documents, each a Spark job on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import stages
from lintlake.llm.shared import written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language", stages.keep_languages),
    ("near_duplicates", stages.one_of_each_group),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: SQL can't express the stages' models and tokenizers; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
