"""Delimited tables, and stages of tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has all the columns; else an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, required: list[str], encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A delimited table with a header; byte-order marks are taken off the first name, all columns are text."""
    df = spark.read.csv(path, header=True, encoding=encoding, sep=sep, escape='"', multiLine=True)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return require(df.toDF(*names), required)


def write_stage(df: DataFrame, path: str, keys: list[str] = (), fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Write a stage's table, keys first."""
    order = [*keys, *(c for c in df.columns if c not in keys)]
    writer = df.select(*order).write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_residue_list(keys: DataFrame, path: str, key: str = "key") -> None:
    """Keys as text, one in a line, by chain, number and insertion code."""
    from screenspark.operators.residues import residue_struct

    keys.select(F.col(key).alias("value"), residue_struct(key).alias("_o")).distinct().orderBy("_o").select("value").write.text(path)
