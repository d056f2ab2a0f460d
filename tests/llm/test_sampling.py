"""Bounded samples: every label, exact bounds, nothing lost at any size."""

import pytest
from pyspark.sql import functions as F

from screenspark.llm.sampling import fresh, labelled_sample, under_share


def test_bound_is_not_empty_at_any_size(spark):
    one = spark.range(1)
    for rows in (1e3, 1e10, 1e15):
        got = one.select(under_share(F.lit(-(2**63)), F.lit(600.0), F.lit(rows)).alias("low"), under_share(F.lit(2**63 - 1), F.lit(600.0), F.lit(rows)).alias("high")).first()
        assert got["low"] and got["high"] == (rows <= 600)
    assert spark.range(100_000).filter(under_share(F.xxhash64("id"), F.lit(600.0), F.lit(100_000.0))).count() == pytest.approx(600, abs=120)


def test_null_and_repeated_ids_stay_within_the_bound(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 2990, F.lit("a")).otherwise("b").alias("lang"))
    got = {r["lang"]: r["count"] for r in labelled_sample(rows, "lang", 25).groupBy("lang").count().collect()}
    assert got == {"a": 25, "b": 10}


def test_all_labels_are_taken_and_the_total_is_bounded(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 200).alias("lang"))
    got = labelled_sample(rows, "lang", 50, total=400).groupBy("lang").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {2}
    assert labelled_sample(rows.filter("doc_id < 0"), "lang", 50).count() == 0


def test_fresh_names_avoid_clashes_in_any_case():
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
