"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Full scan of a table (SC1); Catalyst prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
