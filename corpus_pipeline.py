"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import stages

STAGES = stages.STAGES
#: Learning, tilting and encoding cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    return stages.run(spark, sf_dir)
