"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory``; columns and filters are pushed into the scan by the callers."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
