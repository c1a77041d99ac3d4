"""Parquet table access by name below one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
