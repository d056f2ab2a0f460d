"""Equal scores whose last bits differ by the order of their sums: ties stay ties, thresholds are reached."""

from pyspark.sql import functions as F

from screenspark.operators import consensus as c
from screenspark.operators import decisions, scoring

LOW, HIGH = 0.3, 0.1 + 0.2  # the same number but for its last bit


def test_topk_ties_go_by_item(spark):
    d = spark.createDataFrame([("c", "v", "b", HIGH), ("c", "v", "a", LOW), ("c", "v", "d", 0.1)], "candidate string, variant string, item string, rule_score double")
    rows = scoring.select_topk(d, 2).orderBy("topk_position").collect()
    assert [r["item"] for r in rows] == ["a", "b"]


def test_hit_at_the_threshold_and_best_variant(spark):
    d = spark.createDataFrame([(1, "a", 1, HIGH, 0.7 - 0.2), (1, "b", 1, LOW, 0.3)], "candidate long, variant string, n_items long, variant_score double, mean_site_hit_fraction double")
    assert 0.7 - 0.2 < 0.5
    row = scoring.rollup_candidates(d).first()
    assert row["best_variant"] == "b"
    assert abs(row["consistency"] - (0.6 * 0.4 + 0.3 * 0.5 + 0.1 * 0.9)) < 1e-9


def test_ranks_of_candidates(spark):
    d = spark.createDataFrame([(2, HIGH, 0.5), (1, LOW, 0.5)], "candidate long, final_score double, best_variant_score double")
    assert [r["candidate"] for r in scoring.assign_rank(d, scoring.final_order()).orderBy("rank").collect()] == [1, 2]


def test_consensus_ranks_flags_and_tiers(spark):
    ranks = "candidate long, score double, rank int, std double, overwide double"
    a = spark.createDataFrame([(2, HIGH, 1, 0.7 - 0.55, 0.1), (1, LOW, 1, 0.0, 0.1)], ranks)
    qc = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "candidate long, failed_fraction double, warning_fraction double")
    rows = {r["candidate"]: r for r in c.consensus(a, a, qc).collect()}
    assert 0.7 - 0.55 < 0.15
    assert rows[2]["unstable"]
    assert rows[1]["consensus_rank"] == 1
    d = spark.sql("SELECT 'standard' AS decision_tier, 0.9D AS confidence_score, 0D AS qc_risk, 0D AS abs_rank_delta, 1D AS source_coverage, false AS close_competition, false AS unstable")
    score = 0.7 - 2**-53
    assert score < 0.7
    assert decisions.suggest(d.withColumn("consensus_score", F.lit(score))).first()["tier"] == "review_first"
