"""Readers for the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` (one Parquet file or a folder of them) of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
