"""Consensus of two rankings, its risk flags, gaps and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, flags, mean_of, severity, steady
from screenspark.operators.scoring import assign_rank

#: Metrics of a pairwise comparison and whether more or less is better.
COMPARED = {
    "consensus_score": "higher", "confidence_score": "higher", "b_score": "higher", "a_score": "higher", "rank_agreement": "higher",
    "score_alignment": "higher", "source_coverage": "higher", "b_mean_site_hit_fraction": "higher", "a_mean_site_hit_fraction": "higher",
    "b_mean_anchor_hit_fraction": "higher", "a_mean_anchor_hit_fraction": "higher", "b_mean_mouth_occlusion": "higher", "a_mean_mouth_occlusion": "higher",
    "b_mean_path_score": "higher", "a_mean_path_score": "higher", "qc_risk": "lower", "abs_rank_delta": "lower", "score_gap": "lower",
    "overwide": "lower", "b_mean_overwide": "lower", "a_mean_overwide": "lower",
}


def merge_rankings(a: DataFrame, b: DataFrame, key: str = "candidate") -> DataFrame:
    """Full outer join of two rankings; other columns get the prefixes ``a_`` and ``b_``; ``source`` says where a row is from."""
    left = a.select(key, *(F.col(c).alias(f"a_{c}") for c in a.columns if c != key), F.lit(True).alias("_a"))
    right = b.select(key, *(F.col(c).alias(f"b_{c}") for c in b.columns if c != key), F.lit(True).alias("_b"))
    both = left.join(right, key, "full")
    return both.withColumn("source", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left_only").otherwise("right_only")).drop("_a", "_b")


def qc_by_candidate(items: DataFrame) -> DataFrame:
    """Rows, failed and warning shares and over-wide proxy of each candidate."""
    failed, warned = F.count_if(F.col("status") != "ok"), F.count_if(F.col("has_warning"))
    out = items.groupBy("candidate").agg(F.count("*").alias("n_rows"), failed.alias("n_failed"), warned.alias("n_warning"), F.avg("overwide").alias("qc_mean_overwide"), F.max("overwide").alias("qc_max_overwide"))
    return out.withColumn("failed_fraction", F.col("n_failed") / F.col("n_rows")).withColumn("warning_fraction", F.col("n_warning") / F.col("n_rows"))


def enrich(df: DataFrame, side: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join; Spark broadcasts the side if its size allows."""
    return df.join(side, on, "left")


def consensus(a: DataFrame, b: DataFrame, qc: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Consensus of two rankings with ``candidate, score, rank, std`` (and ``overwide``, optional).

    Ranked by consensus, confidence and mean score at nine digits, and candidate.
    """
    m = enrich(merge_rankings(a, b), qc, "candidate")
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    m = m.withColumn("n", n)  # candidate-sized table
    gap, delta = F.abs(F.col("a_score") - F.col("b_score")), F.abs(F.col("a_rank") - F.col("b_rank"))
    m = m.withColumn("mean_score", F.coalesce(mean_of(F.col("a_score"), F.col("b_score")), F.lit(0.0))).withColumn("score_gap", gap).withColumn("abs_rank_delta", delta.cast("double"))
    m = m.withColumn("score_alignment", F.when(gap.isNull(), 0.5).otherwise(1 - clip(gap / 0.5, 0, 1)))
    m = m.withColumn("rank_agreement", F.when(delta.isNull(), 0.5).otherwise(1 - clip(delta / F.greatest(F.col("n") - 1, F.lit(1)), 0, 1)))
    m = m.withColumn("source_coverage", F.when(F.col("source") == "both", 1.0).otherwise(0.5))
    wide = [F.col(c) for c in ("a_overwide", "b_overwide", "qc_mean_overwide", "qc_max_overwide") if c in m.columns]
    m = m.withColumn("overwide", mean_of(*wide) if wide else F.lit(None).cast("double"))
    m = m.withColumn("qc_risk", clip(F.greatest(severity("overwide", threshold), F.coalesce("failed_fraction", F.lit(0.0)), 0.5 * F.coalesce("warning_fraction", F.lit(0.0))), 0, 1))
    m = m.withColumn("confidence_score", 0.45 * F.col("rank_agreement") + 0.25 * F.col("score_alignment") + 0.20 * F.col("source_coverage") + 0.10 * (1 - F.col("qc_risk")))
    m = m.withColumn("consensus_score", clip(0.70 * F.col("mean_score") + 0.20 * F.col("rank_agreement") + 0.10 * F.col("score_alignment") - 0.15 * F.col("qc_risk"), 0, 1))
    m = m.withColumn("instability", F.coalesce(F.greatest("a_std", "b_std"), F.lit(0.0)))
    order = [*(F.desc_nulls_last(steady(s)) for s in ("consensus_score", "confidence_score", "mean_score")), F.asc("candidate")]
    m = assign_rank(m, order, "consensus_rank")
    limit = F.greatest(F.lit(2.0), F.ceil(steady(0.2 * F.col("n"))).cast("double"))
    return (
        m.withColumn("disagreement", F.coalesce(F.col("abs_rank_delta") >= limit, F.lit(False)))
        .withColumn("gap_warning", F.coalesce(steady("score_gap") >= 0.25, F.lit(False)))
        .withColumn("low_agreement", steady("rank_agreement") < 0.70)
        .withColumn("low_alignment", steady("score_alignment") < 0.70)
        .withColumn("overwide_warning", F.coalesce(steady("overwide") >= threshold, F.lit(False)))
        .withColumn("unstable", steady("instability") >= 0.15)
        .drop("n")
    )


def score_gaps(df: DataFrame, score: str = "consensus_score", rank: str = "consensus_rank", close: float = 0.03) -> DataFrame:
    """Gaps to the previous and next row by rank, the nearest of them, and whether the competition is close."""
    w = Window.partitionBy(F.lit(0)).orderBy(rank)
    df = near_ties(df, score, close)
    df = df.withColumn("previous_gap", F.lag(score).over(w) - F.col(score)).withColumn("next_gap", F.col(score) - F.lead(score).over(w))
    df = df.withColumn("nearest_gap", F.least("previous_gap", "next_gap"))
    return df.withColumn("close_competition", F.coalesce(F.round("nearest_gap", 9) <= close, F.lit(False)) | (F.col("near_ties") > 0))


def near_ties(df: DataFrame, score: str, delta: float) -> DataFrame:
    """Number of other rows whose score differs by ``delta`` at most, on scores rounded to 9 digits.

    Rows up to the upper end less those below the lower end: both counts only ever
    grow along the order, while a frame with two moving ends is counted anew for each row.
    """
    units = F.round(F.col(score) * 1e9).cast("long")
    width = round(delta * 1e9)
    w = Window.partitionBy(F.lit(0)).orderBy("_u")
    upto = lambda end: F.count("_u").over(w.rangeBetween(Window.unboundedPreceding, end))
    return df.withColumn("_u", units).withColumn("near_ties", F.when(F.col("_u").isNull(), 0).otherwise(upto(width) - upto(-width - 1) - 1)).drop("_u")


def level(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.50, "medium").otherwise("low")


def review_fields(df: DataFrame) -> DataFrame:
    """Risk flags, review reasons, confidence level and decision tier of a consensus with gaps."""
    failed, warned = F.coalesce(F.col("failed_fraction"), F.lit(0.0)) > 0, F.coalesce(steady("warning_fraction"), F.lit(0.0)) >= 0.25
    risk = flags(("rank_disagreement", F.col("disagreement")), ("score_gap", F.col("gap_warning")), ("overwide", F.col("overwide_warning")), ("instability", F.col("unstable")), ("close_competition", F.col("close_competition")), ("failed_rows", failed), ("many_warnings", warned), ("missing_one_ranker", F.col("source_coverage") < 1))
    review = flags(
        ("missing_one_ranker", F.col("source_coverage") < 1), ("rank_disagreement", F.col("disagreement")), ("score_gap", F.col("gap_warning")), ("low_rank_agreement", F.col("low_agreement")),
        ("low_score_alignment", F.col("low_alignment")), ("overwide", F.col("overwide_warning")), ("instability", F.col("unstable")), ("failed_rows", failed),
        ("many_warnings", warned), ("high_qc_risk", steady("qc_risk") >= 0.40), ("close_competition", F.col("close_competition")),
    )
    c, f, q = steady("consensus_score"), steady("confidence_score"), steady("qc_risk")
    tier = F.when((c >= 0.75) & (f >= 0.65) & (q < 0.40), "priority").when((c >= 0.65) | (f < 0.50) | (q >= 0.40), "review").otherwise("standard")
    return df.withColumn("risk_flags", risk).withColumn("review_flags", review).withColumn("confidence_level", level(f)).withColumn("decision_tier", tier)


def rank_delta(before: DataFrame, after: DataFrame, k: int, key: str = "candidate") -> DataFrame:
    """Changes between two rankings (score, rank): deltas, and entered or left the top k (no rank: not in it)."""
    b = before.select(key, F.col("score").alias("before_score"), F.col("rank").alias("before_rank"))
    a = after.select(key, F.col("score").alias("after_score"), F.col("rank").alias("after_rank"))
    d = b.join(a, key, "full")
    was, now = F.coalesce(F.col("before_rank") <= k, F.lit(False)), F.coalesce(F.col("after_rank") <= k, F.lit(False))
    return d.withColumn("rank_delta", F.col("after_rank") - F.col("before_rank")).withColumn("improvement", F.col("before_rank") - F.col("after_rank")).withColumn("score_delta", F.col("after_score") - F.col("before_score")).withColumn("entered", now & ~was).withColumn("left", was & ~now)


def pairs(ranked: DataFrame, mode: str = "adjacent", top_n: int = 20, selected: list | None = None) -> DataFrame:
    """Pairs of ranks to compare: ``adjacent``, ``top_vs_rest`` or ``all``, of the first ``top_n`` (or the selected) candidates."""
    r = ranked.select("candidate", "consensus_rank")
    if selected is not None:
        r = r.filter(F.col("candidate").isin(selected))
        r = assign_rank(r, [F.asc("consensus_rank")], "_p")
    else:
        r = r.filter(F.col("consensus_rank") <= top_n).withColumn("_p", F.col("consensus_rank"))
    x, y = r.alias("x"), r.alias("y")
    on = {"adjacent": F.col("x._p") + 1 == F.col("y._p"), "top_vs_rest": (F.col("x._p") == 1) & (F.col("y._p") > 1), "all": F.col("x._p") < F.col("y._p")}[mode]
    return x.join(y, on).select(F.col("x.candidate").alias("left"), F.col("y.candidate").alias("right"), F.col("x.consensus_rank").alias("left_rank"), F.col("y.consensus_rank").alias("right_rank"))


def compare_pairs(ranked: DataFrame, mode: str = "adjacent", top_n: int = 20, close: float = 0.03, n_up: int = 4, n_down: int = 3) -> DataFrame:
    """Pairs with the metrics where the left side leads most and trails most, and whether the decision is close."""
    names = [c for c in COMPARED if c in ranked.columns]
    packed = ranked.select("candidate", F.col("consensus_score").alias("_s"), F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v"), F.lit(1 if COMPARED[c] == "higher" else -1).alias("d")) for c in names)).alias("_m"))
    p = pairs(ranked, mode, top_n)
    left, right = (packed.select(F.col("candidate").alias(s), F.col("_s").alias(f"{s}_score"), F.col("_m").alias(f"{s}_m")) for s in ("left", "right"))
    p = p.join(left, "left").join(right, "right")
    edge = F.zip_with("left_m", "right_m", lambda x, y: F.struct(F.round((x["v"] - y["v"]) * x["d"], 9).alias("e"), x["m"].alias("m")))
    p = p.withColumn("_e", F.filter(edge, lambda x: x["e"].isNotNull()))

    def names_of(cond, sign: int, n: int) -> Column:
        rows = F.transform(F.filter("_e", cond), lambda x: F.struct((x["e"] * -sign).alias("o"), x["m"].alias("m")))
        return F.transform(F.slice(F.array_sort(rows), 1, n), lambda x: x["m"])

    return p.select("left", "right", "left_rank", "right_rank", names_of(lambda x: x["e"] > 0, 1, n_up).alias("advantages"), names_of(lambda x: x["e"] < 0, -1, n_down).alias("counterpoints"), (F.round(F.abs(F.col("left_score") - F.col("right_score")), 9) <= close).alias("close"))


def tradeoffs(ranked: DataFrame) -> DataFrame:
    """Strengths and risks of each candidate of a reviewed consensus."""
    strong = flags(("high_consensus", F.round("consensus_score", 9) >= 0.75), ("high_confidence", F.round("confidence_score", 9) >= 0.75), ("rank_agreement", F.round("rank_agreement", 9) >= 0.85), ("score_alignment", F.round("score_alignment", 9) >= 0.85), ("low_qc_risk", F.round("qc_risk", 9) < 0.20))
    return ranked.select("candidate", "consensus_rank", strong.alias("strengths"), F.col("review_flags").alias("risks"), "nearest_gap", "close_competition")


def explain(ranked: DataFrame, n: int = 4) -> DataFrame:
    """Up to ``n`` reason codes for each candidate's score, in order; a fallback if none holds."""
    codes = flags(
        ("site_coverage_high", F.round("a_mean_site_hit_fraction", 9) >= 0.5), ("anchor_contact_high", F.round("a_mean_anchor_hit_fraction", 9) >= 0.05), ("mouth_occlusion_high", F.round("a_mean_mouth_occlusion", 9) >= 0.5),
        ("variants_stable", F.round("instability", 9) < 0.05), ("rankers_agree", F.round("rank_agreement", 9) >= 0.8), ("qc_risk_low", F.round("qc_risk", 9) < 0.2), ("overwide_site", F.col("overwide_warning")),
    )
    return ranked.select("candidate", F.when(F.size(codes) == 0, F.array(F.lit("no_dominant_reason"))).otherwise(F.slice(codes, 1, n)).alias("reasons"))


def score_cards(ranked: DataFrame) -> DataFrame:
    """Band, up to five positive factors and six risks, recommended action and agreement note."""
    band = F.when(F.round("consensus_score", 9) >= 0.75, "strong").when(F.round("consensus_score", 9) >= 0.60, "good").when(F.round("consensus_score", 9) >= 0.45, "fair").otherwise("weak")
    good = flags(("consensus", F.round("consensus_score", 9) >= 0.60), ("confidence", F.round("confidence_score", 9) >= 0.65), ("agreement", F.round("rank_agreement", 9) >= 0.80), ("alignment", F.round("score_alignment", 9) >= 0.80), ("coverage", F.col("source_coverage") >= 1), ("low_risk", F.round("qc_risk", 9) < 0.20))
    action = F.when(F.col("decision_tier") == "priority", "validate").when(F.round("qc_risk", 9) >= 0.40, "check_quality").when(F.col("disagreement"), "compare_rankers").when(F.col("decision_tier") == "review", "manual_review").otherwise("keep")
    note = F.when(F.col("source") != "both", "single_source").when(F.col("disagreement"), "disagree").otherwise("agree")
    return ranked.select("candidate", band.alias("band"), F.slice(good, 1, 5).alias("positives"), F.slice("review_flags", 1, 6).alias("risks"), action.alias("action"), note.alias("agreement"))


def group_summary(ranked: DataFrame, group: str, terms: str = "review_flags", n_terms: int = 3) -> DataFrame:
    """Digest of each group: best candidate, means, counts, members by rank and most common terms."""
    base = ranked.groupBy(group).agg(
        F.count("*").alias("n"), F.min_by("candidate", "consensus_rank").alias("best"), F.avg("consensus_score").alias("mean_consensus"), F.avg("confidence_score").alias("mean_confidence"),
        F.count_if(F.col("confidence_level") == "low").alias("n_low"), F.count_if(F.col("decision_tier") == "review").alias("n_review"), F.count_if("close_competition").alias("n_close"),
        F.transform(F.array_sort(F.collect_list(F.struct("consensus_rank", "candidate"))), lambda x: x["candidate"]).alias("members"),
    )
    counted = ranked.select(group, F.explode(terms).alias("term")).groupBy(group, "term").count()
    w = Window.partitionBy(group).orderBy(F.desc("count"), "term")
    top = counted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_terms).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("top_terms"))
    return base.join(top, group, "left").withColumn("top_terms", F.coalesce("top_terms", F.array().cast("array<string>")))


def value_counts(df: DataFrame, column: str, explode: bool = False) -> DataFrame:
    """Rows of each value; an array column may be exploded first."""
    d = df.select(F.explode(column).alias("value")) if explode else df.select(F.col(column).alias("value"))
    return d.groupBy("value").agg(F.count("*").alias("n"))


def headline(ranked: DataFrame) -> DataFrame:
    """Four picks: best, most stable, of highest risk, and next to test."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    r = ranked.withColumn("_n", n)
    stable = 0.50 * F.col("confidence_score") + 0.30 * F.col("consensus_score") - 0.18 * F.col("qc_risk") - 0.04 * F.size("risk_flags") - 0.03 * F.col("consensus_rank") / F.col("_n")
    risk = 0.45 * F.col("qc_risk") + 0.25 * (1 - F.col("confidence_score")) + 0.08 * F.size("risk_flags") + 0.12 * F.size("review_flags")
    tie = -F.col("candidate")
    picks = r.agg(
        F.min_by("candidate", "consensus_rank").alias("best"), F.max_by("candidate", F.struct(F.round(stable, 9), tie)).alias("most_stable"), F.max_by("candidate", F.struct(F.round(risk, 9), tie)).alias("highest_risk"),
        F.min_by("candidate", F.struct(F.when(F.col("decision_tier") == "priority", 0).when(F.col("decision_tier") == "review", 1).otherwise(2), "consensus_rank")).alias("next_to_test"),
    )
    return picks


def candidate_cards(ranked: DataFrame, items: DataFrame, wins: DataFrame, score: str = "rule_score", n: int = 3) -> DataFrame:
    """Card of each candidate: its QC counts, best items by score, and how many pair comparisons it leads or trails."""
    w = Window.partitionBy("candidate").orderBy(F.desc_nulls_last(F.round(score, 9)), "item")
    top = items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda x: x["item"]).alias("top_items"))
    led = wins.groupBy(F.col("left").alias("candidate")).agg(F.count("*").alias("n_ahead"))
    lost = wins.groupBy(F.col("right").alias("candidate")).agg(F.count("*").alias("n_behind"))
    d = ranked.select("candidate", "consensus_rank", "decision_tier", "n_rows", "n_failed", "n_warning").join(top, "candidate", "left").join(led, "candidate", "left").join(lost, "candidate", "left")
    return d.withColumn("n_ahead", F.coalesce("n_ahead", F.lit(0))).withColumn("n_behind", F.coalesce("n_behind", F.lit(0)))


def batch_decision(gate_status: DataFrame, evidence_status: DataFrame, picks: DataFrame) -> DataFrame:
    """One row: what the batch's quality and evidence allow, and the candidate to look at next."""
    d = gate_status.select(F.col("status").alias("quality")).join(evidence_status.select(F.col("status").alias("evidence")), how="full", on=F.lit(True)).join(picks.select("next_to_test"), how="left", on=F.lit(True))
    tier = F.when(F.col("quality") == "FAIL", "fix_inputs_first").when(F.col("quality") == "WARN", "review_before_experiment").when(F.col("quality") == "PASS", "ready_for_candidate_review").otherwise("unknown_quality_status")
    note = F.when(F.col("quality") == "FAIL", "rerun_after_fix").when(F.col("evidence").isin("WARN", "FAIL"), "follow_evidence_action").when(F.col("evidence") == "PASS", "evidence_sufficient").otherwise("none")
    return d.withColumn("decision_tier", tier).withColumn("evidence_note", note)


def recommend_penalty(rows: DataFrame, best: DataFrame, min_structures: int = 3, min_methods: int = 3, min_each_class: int = 2) -> DataFrame:
    """Whether a default over-wide penalty is backed by enough structures, classes and methods; else the blockers.

    ``rows`` has structure, method, proxy, risk (boolean); ``best`` one row with threshold.
    """
    a = rows.agg(F.countDistinct("structure").alias("n_structures"), F.countDistinct("method").alias("n_methods"), F.count_if("risk").alias("n_risk"), F.count_if(~F.col("risk")).alias("n_clear"), F.count("proxy").alias("n_proxy"), F.count("*").alias("n_rows"))
    b = flags(("few_structures", F.col("n_structures") < min_structures), ("small_class", F.least("n_risk", "n_clear") < min_each_class), ("few_methods", F.col("n_methods") < min_methods), ("missing_proxy", F.col("n_proxy") < F.col("n_rows")))
    d = a.withColumn("blockers", b).join(best.select("threshold"), how="left", on=F.lit(True))
    ok = F.size("blockers") == 0
    return d.withColumn("policy", F.when(ok, "enable_small_penalty_after_review").otherwise("keep_default_penalty_off")).withColumn("weight", F.when(ok, 0.10).otherwise(0.0))
