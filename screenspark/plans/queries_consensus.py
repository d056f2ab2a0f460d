"""Queries: consensus of two rankings and what is derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import consensus as c
from screenspark.operators import decisions, scoring
from screenspark.plans import views as v
from screenspark.plans.registry import register, select_sql
from screenspark.plans.staging import stage

WEIGHTS_B = (0.25, 0.50, 0.20, 0.05)
_COLS = ["score", "rank", "std", "overwide", "mean_site_hit_fraction", "mean_anchor_hit_fraction", "mean_mouth_occlusion", "mean_overwide"]


def spread(second: bool):
    """Scores of the demonstration: every eighth candidate stands apart, some of them only in the first ranking; the others lie close together."""
    i = F.col("candidate")
    apart = 0.40 + 0.60 * (F.floor(i / 8) % 13) / 13 + 0.02 * F.col("final_score")
    return F.when(i % 8 == 0, apart - F.when((i % 24 == 0) & F.lit(second), 0.35).otherwise(0.0)).otherwise(0.7 * F.col("final_score"))


def spread_sql(second: bool) -> str:
    return f"CASE WHEN candidate % 8 = 0 THEN 0.40 + 0.60 * ((candidate // 8) % 13) / 13 + 0.02 * final_score - CASE WHEN candidate % 24 = 0 AND {second} THEN 0.35 ELSE 0 END ELSE 0.7 * final_score END"


def ranking(spark, sf_dir, weights=(0.50, 0.25, 0.20, 0.15), gaps=False, variants=None):
    """One of the two rankings; with gaps, some candidates are missing."""
    variants = variants or scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.ranked_items(spark, sf_dir))))
    d = scoring.rollup_candidates(variants, weights).withColumn("final_score", spread(gaps))
    if gaps:
        d = d.filter(F.col("candidate") % 10 != 3)
    d = scoring.assign_rank(d, scoring.final_order())
    return d.select("candidate", F.col("final_score").alias("score"), "rank", F.col("std_variant_score").alias("std"), F.col("mean_overwide").alias("overwide"), *_COLS[4:])


def both(spark, sf_dir, items=None, scored=None):
    """Two rankings over variants that are rolled up once; both are tables of candidate size.

    The scored rows have their columns scaled by bounds of the same rows already.
    """
    scored = scored or scoring.rule_score(scoring.keep_ok(items or v.ranked_items(spark, sf_dir)))
    variants = stage(scoring.rollup_variants(scored, is_scaled=True), "variants")
    return stage(ranking(spark, sf_dir, variants=variants), "ranking"), stage(ranking(spark, sf_dir, WEIGHTS_B, True, variants), "ranking")


def reviewed(spark, sf_dir, items=None, scored=None):
    items = items or v.ranked_items(spark, sf_dir)
    return stage(c.review_fields(c.score_gaps(c.consensus(*both(spark, sf_dir, items, scored), c.qc_by_candidate(items)))), "consensus")


_SIDE = "candidate, score, rank, std_variant_score AS std, mean_overwide AS overwide, mean_site_hit_fraction, mean_anchor_hit_fraction, mean_mouth_occlusion, mean_overwide"
RANKINGS = [
    v.ITEMS, v.SCORED, v.variants_ctes(), v.candidates_ctes(), v.candidates_ctes(out="candb", weights=WEIGHTS_B),
    *(f"r{n} AS (SELECT * EXCLUDE (bv) REPLACE (CAST(row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, round(bv, 9) DESC NULLS LAST, candidate) AS INTEGER) AS rank) FROM (SELECT {_SIDE}, best_variant_score AS bv FROM (SELECT *, {spread_sql(n == 'b')} AS score FROM {source}) WHERE {where}))" for n, source, where in (("a", "candidates", "TRUE"), ("b", "candb", "candidate % 10 <> 3"))),
]
QC = """qc AS (SELECT candidate, count(*) AS n_rows, count_if(status <> 'ok') AS n_failed, count_if(has_warning) AS n_warning, avg(overwide) AS qc_mean_overwide, max(overwide) AS qc_max_overwide,
  count_if(status <> 'ok') / count(*) AS failed_fraction, count_if(has_warning) / count(*) AS warning_fraction FROM items GROUP BY candidate)"""
_PRE = ", ".join(f"ra.{x} AS a_{x}, rb.{x} AS b_{x}" for x in _COLS)
_WIDE = v.mean_sql([(x, 1.0) for x in ("a_overwide", "b_overwide", "qc_mean_overwide", "qc_max_overwide")])
CONSENSUS = [*RANKINGS, QC, f"""m0 AS (SELECT coalesce(ra.candidate, rb.candidate) AS candidate, {_PRE}, CASE WHEN ra.candidate IS NOT NULL AND rb.candidate IS NOT NULL THEN 'both' WHEN ra.candidate IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS source FROM ra FULL JOIN rb ON ra.candidate = rb.candidate),
m1 AS (SELECT *, count(*) OVER () AS n, coalesce({v.mean_sql([("a_score", 1.0), ("b_score", 1.0)])}, 0) AS mean_score, abs(a_score - b_score) AS score_gap, CAST(abs(a_rank - b_rank) AS DOUBLE) AS abs_rank_delta FROM m0 LEFT JOIN qc USING (candidate)),
m2 AS (SELECT *, CASE WHEN score_gap IS NULL THEN 0.5 ELSE 1 - greatest(0, least(1, score_gap / 0.5)) END AS score_alignment, CASE WHEN abs_rank_delta IS NULL THEN 0.5 ELSE 1 - greatest(0, least(1, abs_rank_delta / greatest(n - 1, 1))) END AS rank_agreement,
  CASE WHEN source = 'both' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS source_coverage, {_WIDE} AS overwide FROM m1),
m3 AS (SELECT *, least(1, greatest(CASE WHEN overwide IS NULL OR overwide <= 0.55 THEN 0 ELSE least(1, (overwide - 0.55) / 0.45) END, coalesce(failed_fraction, 0), 0.5 * coalesce(warning_fraction, 0))) AS qc_risk FROM m2),
m4 AS (SELECT *, 0.45 * rank_agreement + 0.25 * score_alignment + 0.20 * source_coverage + 0.10 * (1 - qc_risk) AS confidence_score, greatest(0, least(1, 0.70 * mean_score + 0.20 * rank_agreement + 0.10 * score_alignment - 0.15 * qc_risk)) AS consensus_score, coalesce(greatest(a_std, b_std), 0) AS instability FROM m3),
m5 AS (SELECT *, CAST(row_number() OVER (ORDER BY round(consensus_score, 9) DESC NULLS LAST, round(confidence_score, 9) DESC NULLS LAST, round(mean_score, 9) DESC NULLS LAST, candidate) AS INTEGER) AS consensus_rank, coalesce(abs_rank_delta >= greatest(2.0, ceil(0.2 * n)), FALSE) AS disagreement, coalesce(round(score_gap, 9) >= 0.25, FALSE) AS gap_warning,
  round(rank_agreement, 9) < 0.70 AS low_agreement, round(score_alignment, 9) < 0.70 AS low_alignment, coalesce(round(overwide, 9) >= 0.55, FALSE) AS overwide_warning, round(instability, 9) >= 0.15 AS unstable FROM m4),
m6 AS (SELECT *, CAST(round(consensus_score * 1e9) AS BIGINT) AS u FROM m5),
m7 AS (SELECT *, count(u) OVER (ORDER BY u RANGE BETWEEN 30000000 PRECEDING AND 30000000 FOLLOWING) - 1 AS near_ties, lag(consensus_score) OVER w - consensus_score AS previous_gap, consensus_score - lead(consensus_score) OVER w AS next_gap FROM m6 WINDOW w AS (ORDER BY consensus_rank)),
m8 AS (SELECT *, least(previous_gap, next_gap) AS nearest_gap FROM m7),
m9 AS (SELECT *, coalesce(round(nearest_gap, 9) <= 0.03, FALSE) OR near_ties > 0 AS close_competition FROM m8),
cons AS (SELECT *,
  list_filter([CASE WHEN disagreement THEN 'rank_disagreement' END, CASE WHEN gap_warning THEN 'score_gap' END, CASE WHEN overwide_warning THEN 'overwide' END, CASE WHEN unstable THEN 'instability' END, CASE WHEN close_competition THEN 'close_competition' END, CASE WHEN coalesce(failed_fraction, 0) > 0 THEN 'failed_rows' END, CASE WHEN round(coalesce(warning_fraction, 0), 9) >= 0.25 THEN 'many_warnings' END, CASE WHEN source_coverage < 1 THEN 'missing_one_ranker' END], lambda x: x IS NOT NULL) AS risk_flags,
  list_filter([CASE WHEN source_coverage < 1 THEN 'missing_one_ranker' END, CASE WHEN disagreement THEN 'rank_disagreement' END, CASE WHEN gap_warning THEN 'score_gap' END, CASE WHEN low_agreement THEN 'low_rank_agreement' END, CASE WHEN low_alignment THEN 'low_score_alignment' END, CASE WHEN overwide_warning THEN 'overwide' END, CASE WHEN unstable THEN 'instability' END, CASE WHEN coalesce(failed_fraction, 0) > 0 THEN 'failed_rows' END, CASE WHEN round(coalesce(warning_fraction, 0), 9) >= 0.25 THEN 'many_warnings' END, CASE WHEN round(qc_risk, 9) >= 0.40 THEN 'high_qc_risk' END, CASE WHEN close_competition THEN 'close_competition' END], lambda x: x IS NOT NULL) AS review_flags,
  CASE WHEN round(confidence_score, 9) >= 0.75 THEN 'high' WHEN round(confidence_score, 9) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level,
  CASE WHEN round(consensus_score, 9) >= 0.75 AND round(confidence_score, 9) >= 0.65 AND round(qc_risk, 9) < 0.40 THEN 'priority' WHEN round(consensus_score, 9) >= 0.65 OR round(confidence_score, 9) < 0.50 OR round(qc_risk, 9) >= 0.40 THEN 'review' ELSE 'standard' END AS decision_tier FROM m9)"""]


@register("jn1_merge_rankings", v.with_sql(*CONSENSUS, select=select_sql("m0", "candidate, source, a_rank, b_rank", "a_score, b_score")))
def jn1_merge_rankings(spark, sf_dir):
    return c.merge_rankings(*both(spark, sf_dir)).select("candidate", "source", "a_rank", "b_rank", "a_score", "b_score")


@register("jn2_enrich", v.with_sql(*CONSENSUS, select="SELECT ra.candidate, rank, n_rows, n_failed FROM ra LEFT JOIN (SELECT * FROM qc WHERE n_failed % 2 = 0) USING (candidate)"))
def jn2_enrich(spark, sf_dir):
    side = c.qc_by_candidate(v.items(spark, sf_dir)).filter("n_failed % 2 = 0").select("candidate", "n_rows", "n_failed")
    return c.enrich(ranking(spark, sf_dir).select("candidate", "rank"), side, "candidate")


@register("jn3_paired_scores", v.with_sql(*CONSENSUS, select="SELECT ra.candidate, round(ra.score - rb.score, 6) AS delta FROM ra JOIN rb USING (candidate)"))
def jn3_paired_scores(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return c.merge_rankings(a, b).filter("source = 'both'").select("candidate", (F.col("a_score") - F.col("b_score")).alias("delta"))


@register("jn4_merge_predictions", v.with_sql(v.ITEMS, v.SCORED, select="SELECT s.candidate, s.variant, s.item, round(s.rule_score, 6) AS rule_score, round(p.site_hit_fraction, 6) AS pred_prob FROM scored s LEFT JOIN (SELECT * FROM items WHERE label = 1) p USING (candidate, variant, item)"))
def jn4_merge_predictions(spark, sf_dir):
    it = stage(v.items(spark, sf_dir), "items")
    pred = it.filter("label = 1").select("candidate", "variant", "item", F.col("site_hit_fraction").alias("pred_prob"))
    return c.enrich(scoring.rule_score(scoring.keep_ok(it)).select("candidate", "variant", "item", "rule_score"), pred, ["candidate", "variant", "item"])


@register("ag8_qc_by_candidate", v.with_sql(v.ITEMS, QC, select=select_sql("qc", "candidate, n_rows, n_failed, n_warning", "qc_mean_overwide, qc_max_overwide, failed_fraction, warning_fraction")))
def ag8_qc_by_candidate(spark, sf_dir):
    return c.qc_by_candidate(v.items(spark, sf_dir))


@register("sc2_overwide_penalty", v.with_sql(v.ITEMS, v.SCORED, v.variants_ctes(penalty=0.2), select=select_sql("variants", "candidate, variant", "variant_score")))
def sc2_overwide_penalty(spark, sf_dir):
    return scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir))), penalty_weight=0.2).select("candidate", "variant", "variant_score")


@register("sc3_consensus", v.with_sql(*CONSENSUS, select=select_sql("m5", "candidate, source, consensus_rank, disagreement, gap_warning, low_agreement, low_alignment, overwide_warning, unstable", "mean_score, score_gap, abs_rank_delta, score_alignment, rank_agreement, source_coverage, overwide, qc_risk, confidence_score, consensus_score, instability")))
def sc3_consensus(spark, sf_dir):
    items = v.ranked_items(spark, sf_dir)
    d = c.consensus(*both(spark, sf_dir, items), c.qc_by_candidate(items))
    return d.select("candidate", "source", "consensus_rank", "disagreement", "gap_warning", "low_agreement", "low_alignment", "overwide_warning", "unstable", "mean_score", "score_gap", "abs_rank_delta", "score_alignment", "rank_agreement", "source_coverage", "overwide", "qc_risk", "confidence_score", "consensus_score", "instability")


@register("wn4_score_gaps", v.with_sql(*CONSENSUS, select=select_sql("m9", "candidate, close_competition", "previous_gap, next_gap, nearest_gap")))
def wn4_score_gaps(spark, sf_dir):
    return reviewed(spark, sf_dir).select("candidate", "close_competition", "previous_gap", "next_gap", "nearest_gap")


@register("wn5_near_ties", v.with_sql(*CONSENSUS, select="SELECT candidate, near_ties FROM m7"))
def wn5_near_ties(spark, sf_dir):
    return reviewed(spark, sf_dir).select("candidate", "near_ties")


@register("fl3_review_fields", v.with_sql(*CONSENSUS, select="SELECT candidate, array_to_string(risk_flags, '|') AS risk_flags, array_to_string(review_flags, '|') AS review_flags, confidence_level, decision_tier FROM cons"))
def fl3_review_fields(spark, sf_dir):
    return reviewed(spark, sf_dir).select("candidate", "risk_flags", "review_flags", "confidence_level", "decision_tier")


@register("jn13_rank_delta", v.with_sql(*CONSENSUS, select="SELECT coalesce(ra.candidate, rb.candidate) AS candidate, rb.rank - ra.rank AS rank_delta, ra.rank - rb.rank AS improvement, round(rb.score - ra.score, 6) AS score_delta, coalesce(rb.rank <= 5, FALSE) AND NOT coalesce(ra.rank <= 5, FALSE) AS entered, coalesce(ra.rank <= 5, FALSE) AND NOT coalesce(rb.rank <= 5, FALSE) AS \"left\" FROM ra FULL JOIN rb ON ra.candidate = rb.candidate"))
def jn13_rank_delta(spark, sf_dir):
    return c.rank_delta(*both(spark, sf_dir), 5).select("candidate", "rank_delta", "improvement", "score_delta", "entered", "left")


for _mode, _on in (("adjacent", "x.consensus_rank + 1 = y.consensus_rank"), ("top_vs_rest", "x.consensus_rank = 1 AND y.consensus_rank > 1"), ("all", "x.consensus_rank < y.consensus_rank")):
    register(f"jn7_pairs_{_mode}", v.with_sql(*CONSENSUS, select=f'SELECT x.candidate AS "left", y.candidate AS "right", x.consensus_rank AS left_rank, y.consensus_rank AS right_rank FROM cons x JOIN cons y ON {_on} WHERE x.consensus_rank <= 20 AND y.consensus_rank <= 20'))(lambda spark, sf_dir, m=_mode: c.pairs(reviewed(spark, sf_dir), m, 20))

_NAMES = [x for x in c.COMPARED if x not in ("a_mean_path_score", "b_mean_path_score")]
_EDGES = " UNION ALL ".join(f"SELECT x.candidate AS l, y.candidate AS r, '{n}' AS m, round((x.{n} - y.{n}) * {1 if c.COMPARED[n] == 'higher' else -1}, 9) AS e FROM cons x JOIN cons y ON x.consensus_rank + 1 = y.consensus_rank WHERE y.consensus_rank <= 20" for n in _NAMES)


@register("fl7_compare_pairs", v.with_sql(*CONSENSUS, f"""e AS ({_EDGES}),
up AS (SELECT l, string_agg(m, '|' ORDER BY e DESC, m) AS advantages FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY e DESC, m) AS k FROM e WHERE e > 0) WHERE k <= 4 GROUP BY l),
dn AS (SELECT l, string_agg(m, '|' ORDER BY e, m) AS counterpoints FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY e, m) AS k FROM e WHERE e < 0) WHERE k <= 3 GROUP BY l)""",
    select="SELECT x.candidate AS \"left\", y.candidate AS \"right\", coalesce(advantages, '') AS advantages, coalesce(counterpoints, '') AS counterpoints, round(abs(x.consensus_score - y.consensus_score), 9) <= 0.03 AS close FROM cons x JOIN cons y ON x.consensus_rank + 1 = y.consensus_rank LEFT JOIN up ON up.l = x.candidate LEFT JOIN dn ON dn.l = x.candidate WHERE y.consensus_rank <= 20"))
def fl7_compare_pairs(spark, sf_dir):
    return c.compare_pairs(reviewed(spark, sf_dir)).select("left", "right", "advantages", "counterpoints", "close")


def flags_sql(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + "], lambda x: x IS NOT NULL)"


@register("fl6_tradeoffs", v.with_sql(*CONSENSUS, select="SELECT candidate, consensus_rank, array_to_string(" + flags_sql([("high_consensus", "round(consensus_score, 9) >= 0.75"), ("high_confidence", "round(confidence_score, 9) >= 0.75"), ("rank_agreement", "round(rank_agreement, 9) >= 0.85"), ("score_alignment", "round(score_alignment, 9) >= 0.85"), ("low_qc_risk", "round(qc_risk, 9) < 0.20")]) + ", '|') AS strengths, array_to_string(review_flags, '|') AS risks, round(nearest_gap, 6) AS nearest_gap, close_competition FROM cons"))
def fl6_tradeoffs(spark, sf_dir):
    return c.tradeoffs(reviewed(spark, sf_dir))


_CODES = flags_sql([("site_coverage_high", "round(a_mean_site_hit_fraction, 9) >= 0.5"), ("anchor_contact_high", "round(a_mean_anchor_hit_fraction, 9) >= 0.05"), ("mouth_occlusion_high", "round(a_mean_mouth_occlusion, 9) >= 0.5"), ("variants_stable", "round(instability, 9) < 0.05"), ("rankers_agree", "round(rank_agreement, 9) >= 0.8"), ("qc_risk_low", "round(qc_risk, 9) < 0.2"), ("overwide_site", "overwide_warning")])


@register("fl4_explain", v.with_sql(*CONSENSUS, select=f"SELECT candidate, CASE WHEN len(k) = 0 THEN 'no_dominant_reason' ELSE array_to_string(k[1:4], '|') END AS reasons FROM (SELECT candidate, {_CODES} AS k FROM cons)"))
def fl4_explain(spark, sf_dir):
    return c.explain(reviewed(spark, sf_dir))


_GOOD = flags_sql([("consensus", "round(consensus_score, 9) >= 0.60"), ("confidence", "round(confidence_score, 9) >= 0.65"), ("agreement", "round(rank_agreement, 9) >= 0.80"), ("alignment", "round(score_alignment, 9) >= 0.80"), ("coverage", "source_coverage >= 1"), ("low_risk", "round(qc_risk, 9) < 0.20")])


@register("fl5_score_cards", v.with_sql(*CONSENSUS, select=f"""SELECT candidate, CASE WHEN round(consensus_score, 9) >= 0.75 THEN 'strong' WHEN round(consensus_score, 9) >= 0.60 THEN 'good' WHEN round(consensus_score, 9) >= 0.45 THEN 'fair' ELSE 'weak' END AS band, array_to_string(({_GOOD})[1:5], '|') AS positives, array_to_string(review_flags[1:6], '|') AS risks,
CASE WHEN decision_tier = 'priority' THEN 'validate' WHEN round(qc_risk, 9) >= 0.40 THEN 'check_quality' WHEN disagreement THEN 'compare_rankers' WHEN decision_tier = 'review' THEN 'manual_review' ELSE 'keep' END AS action, CASE WHEN source <> 'both' THEN 'single_source' WHEN disagreement THEN 'disagree' ELSE 'agree' END AS agreement FROM cons"""))
def fl5_score_cards(spark, sf_dir):
    return c.score_cards(reviewed(spark, sf_dir))


@register("ag23_group_summary", v.with_sql(*CONSENSUS, """t AS (SELECT decision_tier, term, count(*) AS k FROM (SELECT decision_tier, unnest(review_flags) AS term FROM cons) GROUP BY ALL),
tt AS (SELECT decision_tier, string_agg(term, '|' ORDER BY r) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY decision_tier ORDER BY k DESC, term) AS r FROM t) WHERE r <= 3 GROUP BY decision_tier)""",
    select="SELECT decision_tier, n, best, round(mc, 6) AS mean_consensus, round(mf, 6) AS mean_confidence, n_low, n_review, n_close, members, coalesce(top_terms, '') AS top_terms FROM (SELECT decision_tier, count(*) AS n, min_by(candidate, consensus_rank) AS best, avg(consensus_score) AS mc, avg(confidence_score) AS mf, count_if(confidence_level = 'low') AS n_low, count_if(decision_tier = 'review') AS n_review, count_if(close_competition) AS n_close, string_agg(CAST(candidate AS VARCHAR), '|' ORDER BY consensus_rank) AS members FROM cons GROUP BY decision_tier) LEFT JOIN tt USING (decision_tier)"))
def ag23_group_summary(spark, sf_dir):
    return c.group_summary(reviewed(spark, sf_dir), "decision_tier")


@register("ag24_value_counts", v.with_sql(*CONSENSUS, select="SELECT value, count(*) AS n FROM (SELECT unnest(review_flags) AS value FROM cons) GROUP BY value"))
def ag24_value_counts(spark, sf_dir):
    return c.value_counts(reviewed(spark, sf_dir), "review_flags", explode=True)


@register("so4_headline", v.with_sql(*CONSENSUS, "h AS (SELECT *, count(*) OVER () AS nn FROM cons)", select="""SELECT min_by(candidate, consensus_rank) AS best, arg_max(candidate, (round(0.50 * confidence_score + 0.30 * consensus_score - 0.18 * qc_risk - 0.04 * len(risk_flags) - 0.03 * consensus_rank / nn, 9), -candidate)) AS most_stable,
arg_max(candidate, (round(0.45 * qc_risk + 0.25 * (1 - confidence_score) + 0.08 * len(risk_flags) + 0.12 * len(review_flags), 9), -candidate)) AS highest_risk, arg_min(candidate, (CASE decision_tier WHEN 'priority' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, consensus_rank)) AS next_to_test FROM h"""))  # fmt: skip
def so4_headline(spark, sf_dir):
    return c.headline(reviewed(spark, sf_dir))


SUGGEST = [*CONSENSUS, """s0 AS (SELECT *, least(1, greatest(0, 0.44 * coalesce(consensus_score, 0) + 0.16 * (1 - coalesce(confidence_score, 0.5)) + 0.14 * least(1, coalesce(abs_rank_delta, 0) / 3.0) + 0.10 * coalesce(qc_risk, 0) + 0.06 * (1 - coalesce(source_coverage, 1)) + 0.06 * (CASE WHEN close_competition THEN 1 ELSE 0 END) + 0.04 * (CASE WHEN unstable THEN 1 ELSE 0 END))) AS priority_score FROM cons),
s1 AS (SELECT *, CASE WHEN round(priority_score, 9) >= 0.72 OR (decision_tier = 'priority' AND round(consensus_score, 9) >= 0.70 AND round(confidence_score, 9) >= 0.55 AND round(qc_risk, 9) < 0.40) THEN 'validate_now' WHEN round(priority_score, 9) >= 0.52 OR round(consensus_score, 9) >= 0.70 OR round(confidence_score, 9) < 0.55 OR round(qc_risk, 9) >= 0.40 OR coalesce(abs_rank_delta, 0) >= 3 OR close_competition OR unstable THEN 'review_first' ELSE 'backup' END AS tier,
  CASE WHEN close_competition THEN 'close_decision' WHEN coalesce(abs_rank_delta, 0) >= 3 OR list_contains(review_flags, 'rank_disagreement') THEN 'rank_disagreement' WHEN round(qc_risk, 9) >= 0.40 OR list_contains(review_flags, 'overwide') THEN 'qc_or_site_risk' WHEN unstable THEN 'instability' WHEN round(confidence_score, 9) < 0.55 THEN 'low_confidence' WHEN decision_tier = 'priority' AND round(consensus_score, 9) >= 0.70 THEN 'high_confidence_priority' WHEN round(consensus_score, 9) >= 0.70 THEN 'high_score_standard' ELSE 'exploratory' END AS diversity_group FROM s0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY diversity_group ORDER BY CASE tier WHEN 'validate_now' THEN 0 WHEN 'review_first' THEN 1 ELSE 2 END, round(priority_score, 9) DESC, consensus_rank) - 1 AS seen FROM s1),
s3 AS (SELECT *, round(priority_score, 9) - (0.08 * seen + CASE WHEN seen >= 2 THEN 0.08 * (seen - 2 + 1) ELSE 0 END) AS adjusted FROM s2),
sug AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE tier WHEN 'validate_now' THEN 0 WHEN 'review_first' THEN 1 ELSE 2 END, round(adjusted, 9) DESC, round(priority_score, 9) DESC, consensus_rank) AS INTEGER) AS suggestion_rank FROM s3)"""]


@register("sc10_suggest", v.with_sql(*SUGGEST, select=select_sql("s1", "candidate, tier", "priority_score")))
def sc10_suggest(spark, sf_dir):
    return decisions.suggest(reviewed(spark, sf_dir)).select("candidate", "tier", "priority_score")


@register("sc11_diversity_group", v.with_sql(*SUGGEST, select="SELECT candidate, diversity_group FROM s1"))
def sc11_diversity_group(spark, sf_dir):
    return decisions.diversity_group(decisions.suggest(reviewed(spark, sf_dir))).select("candidate", "diversity_group")


@register("sc12_diversify", v.with_sql(*SUGGEST, select="SELECT candidate, suggestion_rank, tier, CAST(seen AS INTEGER) AS seen, round(adjusted, 6) AS adjusted FROM sug"))
def sc12_diversify(spark, sf_dir):
    d = decisions.diversify(decisions.diversity_group(decisions.suggest(reviewed(spark, sf_dir))))
    return d.select("candidate", "suggestion_rank", "tier", "seen", "adjusted")


@register("sc13_plan")
def sc13_plan(spark, sf_dir):
    """Budgeted plan; ten batches of candidates, each planned on its own."""
    d = decisions.diversify(decisions.diversity_group(decisions.suggest(reviewed(spark, sf_dir))))
    return decisions.plan(d.withColumn("batch", F.col("candidate") % 10), total=5, per_tier={"validate_now": 3, "review_first": 3, "backup": 1}, per_group=3)


@register("sc14_next_ledger", v.with_sql(*SUGGEST, select="SELECT candidate, CASE WHEN suggestion_rank <= 10 THEN 'planned' ELSE '' END AS status, suggestion_rank <= 10 AS included FROM sug"))
def sc14_next_ledger(spark, sf_dir):
    d = decisions.diversify(decisions.diversity_group(decisions.suggest(reviewed(spark, sf_dir))))
    return decisions.next_ledger(d.withColumn("included", F.col("suggestion_rank") <= 10).withColumn("status", F.lit(""))).select("candidate", "status", "included")
