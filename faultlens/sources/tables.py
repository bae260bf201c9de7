"""Reading the landed parquet tables (column pruning/pushdown left to Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed parquet table, split as its files and row groups are."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
