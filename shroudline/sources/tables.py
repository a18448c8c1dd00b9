"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Rows of ``<directory>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
