"""Queries: ligand clash, mouth residues, shell evidence, cards and batch decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import consensus as c
from screenspark.operators import decisions, metrics, quality, scoring
from screenspark.operators import sets as s
from screenspark.operators import spatial as g
from screenspark.plans import views as v
from screenspark.plans.queries_consensus import CONSENSUS, reviewed
from screenspark.plans.queries_quality import _AUDIT, _BEST, _GATE, _INFER, LEDGER, _audit
from screenspark.plans.queries_sets import _D, ATOMS, NEAR, SETS, _parts, method_sets, truth
from screenspark.plans.registry import register
from screenspark.plans.staging import stage


@register("ge12_ligand_clash", v.with_sql(ATOMS, NEAR.format(a="site", b="partner"), select="SELECT structure, count(*) AS n_ligand, count_if(dist <= 2.8) AS n_clash, round(avg(greatest(0, least(1, 1 - dist / 4.0))), 6) AS overlap_score, round(count_if(dist <= 2.8) / count(*), 6) AS clash_fraction FROM near GROUP BY structure"))
def ge12_ligand_clash(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return g.ligand_clash(site, p)


@register("ge8_mouth_residues", v.with_sql(ATOMS, "c AS (SELECT structure, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM site GROUP BY 1)", "d AS (SELECT site.structure, id, x, y, z, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 9) AS r, count(*) OVER (PARTITION BY site.structure) AS n FROM site JOIN c ON c.structure = site.structure)",
    "k AS (SELECT a.structure, a.id, count(*) AS k FROM site a JOIN site b ON a.structure = b.structure WHERE " + _D + " <= 2.5 AND " + _D + " > 1e-8 GROUP BY ALL)",
    "e0 AS (SELECT a.structure, a.id, " + _D + " AS dd, row_number() OVER (PARTITION BY a.structure, a.id ORDER BY " + _D + ", b.id) AS o FROM site a JOIN target b ON a.structure = b.structure WHERE " + _D + " <= 3.0)", "e AS (SELECT structure, id, count(*) AS cc, avg(CASE WHEN o <= 5 THEN dd END) AS knn FROM e0 GROUP BY ALL)",
    "m AS (SELECT d.structure, d.id, n, CASE WHEN n > 1 THEN (row_number() OVER (PARTITION BY d.structure ORDER BY r, d.id) - 1) / (n - 1) ELSE 0 END AS radial, 1 - coalesce(k, 0) / greatest(max(coalesce(k, 0)) OVER (PARTITION BY d.structure), 1) AS surface, 0.55 * greatest(0, least(1, coalesce(knn, 3.0) / 3.0)) + 0.45 / (1 + 32 * coalesce(cc, 0) / 27.0) AS ex FROM d LEFT JOIN k ON k.structure = d.structure AND k.id = d.id LEFT JOIN e ON e.structure = d.structure AND e.id = d.id)",
    "f AS (SELECT *, 0.5 * radial + 0.3 * surface + 0.2 * ex AS mouth_score FROM m)", select="SELECT structure, id, round(radial, 6) AS radial, round(surface, 6) AS surface, round(mouth_score, 6) AS mouth_score, row_number() OVER (PARTITION BY structure ORDER BY round(mouth_score, 9) DESC, id) <= greatest(1, ceil(0.3 * n)) AS selected FROM f"))
def ge8_mouth_residues(spark, sf_dir):
    _, site, t, _ = _parts(spark, sf_dir)
    return g.mouth_residues(site, t.withColumn("cid", F.col("id")), 0.30, 2.5, 3.0, 5)


@register("ge17_shell_evidence", v.with_sql(ATOMS, "m AS (SELECT a.structure, a.id AS key, min(" + _D + ") AS distance FROM target a JOIN anchor b ON a.structure = b.structure WHERE a.label <> 0 GROUP BY ALL)", select="SELECT structure, key, CASE WHEN distance <= 1 THEN 'anchor_shell_1' WHEN distance <= 2 THEN 'anchor_shell_2' ELSE 'anchor_shell_3' END AS method, CASE WHEN distance <= 1 THEN 0.65::DOUBLE WHEN distance <= 2 THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END AS weight, round(distance, 6) AS distance FROM m WHERE distance <= 3"))
def ge17_shell_evidence(spark, sf_dir):
    d, _, t, _ = _parts(spark, sf_dir)
    return g.shell_evidence(t, d.filter("label = 0").withColumn("aid", F.col("id")), ((1.0, 0.65), (2.0, 0.45), (3.0, 0.25)))


@register("fl8_candidate_cards", v.with_sql(*CONSENSUS, "t AS (SELECT candidate, string_agg(item, '|' ORDER BY r) AS top_items FROM (SELECT candidate, item, row_number() OVER (PARTITION BY candidate ORDER BY round(rule_score, 9) DESC NULLS LAST, item) AS r FROM scored) WHERE r <= 3 GROUP BY 1)", "p AS (SELECT x.candidate AS l, y.candidate AS r FROM cons x JOIN cons y ON x.consensus_rank < y.consensus_rank WHERE y.consensus_rank <= 20)",
    select="SELECT candidate, consensus_rank, decision_tier, n_rows, CAST(n_failed AS BIGINT) AS n_failed, CAST(n_warning AS BIGINT) AS n_warning, coalesce(top_items, '') AS top_items, (SELECT count(*) FROM p WHERE l = candidate) AS n_ahead, (SELECT count(*) FROM p WHERE r = candidate) AS n_behind FROM cons LEFT JOIN t USING (candidate)"))
def fl8_candidate_cards(spark, sf_dir):
    items = v.ranked_items(spark, sf_dir)
    scored = scoring.rule_score(scoring.keep_ok(items))
    d = reviewed(spark, sf_dir, items, scored)
    out = c.candidate_cards(d, scored, c.pairs(d, "all", 20))
    return out.withColumn("top_items", F.coalesce("top_items", F.array().cast("array<string>")))


@register("fl9_batch_decision", v.with_sql(*CONSENSUS, _GATE, LEDGER, _INFER, _BEST, _AUDIT, "q AS (SELECT arg_max(status, CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS quality FROM checks)", "x AS (SELECT count_if(in_top) AS n_top, count_if(in_top AND gap = 'none') AS n_ready FROM au2)", "y AS (SELECT CASE WHEN n_ready = 0 THEN 'FAIL' WHEN n_ready / n_top < 0.5 THEN 'WARN' ELSE 'PASS' END AS evidence FROM x)", "h AS (SELECT arg_min(candidate, (CASE decision_tier WHEN 'priority' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, consensus_rank)) AS next_to_test FROM cons)",
    select="SELECT quality, evidence, next_to_test, CASE quality WHEN 'FAIL' THEN 'fix_inputs_first' WHEN 'WARN' THEN 'review_before_experiment' WHEN 'PASS' THEN 'ready_for_candidate_review' ELSE 'unknown_quality_status' END AS decision_tier, CASE WHEN quality = 'FAIL' THEN 'rerun_after_fix' WHEN evidence IN ('WARN', 'FAIL') THEN 'follow_evidence_action' WHEN evidence = 'PASS' THEN 'evidence_sufficient' ELSE 'none' END AS evidence_note FROM q, y, h"))
def fl9_batch_decision(spark, sf_dir):
    items = v.ranked_items(spark, sf_dir, "label")
    gate = quality.worst_status(quality.quality_gate(items, "mouth_occlusion", "overwide", "label"))
    return c.batch_decision(gate, decisions.audit_status(_audit(spark, sf_dir)), c.headline(reviewed(spark, sf_dir, items)))


_RISK = "k AS (SELECT structure, key, count(*) AS k FROM ms GROUP BY ALL), g AS (SELECT ms.structure, method, count(*) AS n, count_if(k = 1) AS n_specific, count(t.key) AS hit FROM ms JOIN k ON k.structure = ms.structure AND k.key = ms.key LEFT JOIN truth t ON t.structure = ms.structure AND t.key = ms.key GROUP BY ms.structure, method), h AS (SELECT *, n / median(n) OVER (PARTITION BY structure) AS sr FROM g), pr AS (SELECT structure, method, round(least(1, 0.7 * greatest(0, least(1, (sr - 1) / 2)) + 0.3 * n_specific / n), 9) AS proxy, hit / n < 0.2 AS risk FROM h)"
_BT = "sw AS (SELECT threshold, count_if(risk AND proxy >= threshold) AS tp, count_if(NOT risk AND proxy >= threshold) AS fp, count_if(NOT risk AND proxy < threshold) AS tn, count_if(risk AND proxy < threshold) AS fn FROM pr, (SELECT unnest([0.25, 0.28, 0.3, 0.35]::DOUBLE[]) AS threshold) GROUP BY threshold), bt AS (SELECT threshold FROM (SELECT threshold, (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2 AS ba, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM sw) ORDER BY ba DESC, f1 DESC, threshold LIMIT 1)"


@register("fl11_recommend_penalty", v.with_sql(SETS, _RISK, _BT, "a AS (SELECT count(DISTINCT structure) AS n_structures, count(DISTINCT method) AS n_methods, count_if(risk) AS n_risk, count_if(NOT risk) AS n_clear, count(proxy) AS n_proxy, count(*) AS n_rows FROM pr)", "b AS (SELECT *, list_filter([CASE WHEN n_structures < 3 THEN 'few_structures' END, CASE WHEN least(n_risk, n_clear) < 2 THEN 'small_class' END, CASE WHEN n_methods < 3 THEN 'few_methods' END, CASE WHEN n_proxy < n_rows THEN 'missing_proxy' END], lambda x: x IS NOT NULL) AS bl FROM a)",
    select="SELECT n_structures, n_methods, n_risk, n_clear, n_proxy, n_rows, array_to_string(bl, '|') AS blockers, (SELECT threshold FROM bt) AS threshold, CASE WHEN len(bl) = 0 THEN 'enable_small_penalty_after_review' ELSE 'keep_default_penalty_off' END AS policy, CASE WHEN len(bl) = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM b"))
def fl11_recommend_penalty(spark, sf_dir):
    m = s.method_summary(method_sets(spark, sf_dir), truth(spark, sf_dir))
    rows = stage(m.select("structure", "method", F.round("overwide_risk", 9).alias("proxy"), (F.coalesce("precision", F.lit(0.0)) < 0.2).alias("risk")), "panel")
    best = metrics.best_threshold(metrics.threshold_sweep(rows.withColumn("y", F.col("risk").cast("double")), "y", "proxy", [0.25, 0.28, 0.3, 0.35]))
    return c.recommend_penalty(rows, best)
