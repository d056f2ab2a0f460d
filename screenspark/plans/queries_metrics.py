"""Queries: ranks, metrics, folds and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import metrics as m
from screenspark.operators import scoring, search
from screenspark.plans import views as v
from screenspark.plans.queries_consensus import CONSENSUS, both, ranking, reviewed
from screenspark.plans.registry import register, select_sql
from screenspark.plans.staging import stage
from screenspark.plans.tables import table

SCORED = [v.ITEMS, v.SCORED]


def scored(spark, sf_dir):
    return scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir)))


@register("wn2_min_rank", v.with_sql(v.ITEMS, select="SELECT item, rank() OVER (ORDER BY site_hit_fraction DESC) AS min_rank FROM items"))
def wn2_min_rank(spark, sf_dir):
    return m.min_rank(v.items(spark, sf_dir).select("item", "site_hit_fraction"), "site_hit_fraction").select("item", "min_rank")


_AVG = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@register("wn3_avg_rank", v.with_sql(v.ITEMS, select=f"SELECT item, {_AVG.format(c='site_hit_fraction')} AS avg_rank, round(({_AVG.format(c='site_hit_fraction')}) / count(*) OVER (), 6) AS avg_rank_pct FROM items"))
def wn3_avg_rank(spark, sf_dir):
    return m.avg_rank(v.items(spark, sf_dir).select("item", "site_hit_fraction"), "site_hit_fraction").select("item", "avg_rank", "avg_rank_pct")


_AUC = """auc AS (SELECT n_pos, n_neg, (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc FROM (SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, sum(label * r) AS s FROM (SELECT label, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS r FROM {t})))"""


@register("mx1_auc", v.with_sql(*SCORED, "rs AS (SELECT label, round(rule_score, 9) AS x FROM scored)", _AUC.format(x="x", t="rs"), select=select_sql("auc", "n_pos, n_neg", "auc")))
def mx1_auc(spark, sf_dir):
    return m.auc(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x")


@register("mx1_auc_by_variant", v.with_sql(v.ITEMS, select="SELECT variant, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM (SELECT variant, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, sum(label * r) AS s FROM (SELECT variant, label, rank() OVER (PARTITION BY variant ORDER BY energy_gb) + (count(*) OVER (PARTITION BY variant, energy_gb) - 1) / 2 AS r FROM items) GROUP BY variant)"))
def mx1_auc_by_variant(spark, sf_dir):
    return m.auc(v.items(spark, sf_dir), "label", "energy_gb", ["variant"])


@register("mx2_pearson", v.with_sql(v.ITEMS, select="SELECT count(*) AS n, round(corr(mouth_occlusion, energy_gb), 6) AS pearson FROM items WHERE mouth_occlusion IS NOT NULL"))
def mx2_pearson(spark, sf_dir):
    return m.pearson(v.items(spark, sf_dir), "mouth_occlusion", "energy_gb")


@register("mx3_spearman", v.with_sql(v.ITEMS, select=f"SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT {_AVG.format(c='mouth_occlusion')} AS a, {_AVG.format(c='energy_gb')} AS b FROM items WHERE mouth_occlusion IS NOT NULL)"))
def mx3_spearman(spark, sf_dir):
    return m.spearman(v.items(spark, sf_dir), "mouth_occlusion", "energy_gb")


_KENDALL = "SELECT sum(sign(p.rank - q.rank) * sign(p.r2 - q.r2)) / count(*) FILTER (WHERE sign(p.rank - q.rank) * sign(p.r2 - q.r2) <> 0) FROM j p JOIN j q ON p.candidate < q.candidate"


@register("mx4_kendall", v.with_sql(*CONSENSUS, "j AS (SELECT ra.candidate, ra.rank, rb.rank AS r2 FROM ra JOIN rb USING (candidate))", select=f"SELECT round(({_KENDALL}), 6) AS kendall"))
def mx4_kendall(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return m.kendall(a.select("candidate", "rank").join(b.select("candidate", F.col("rank").alias("r2")), "candidate"), "candidate", "rank", "r2")


_CONF = "count_if(label = 1 AND {x} >= {t}) AS tp, count_if(label = 0 AND {x} >= {t}) AS fp, count_if(label = 0 AND {x} < {t}) AS tn, count_if(label = 1 AND {x} < {t}) AS fn"
_MET = "round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN tn + fp = 0 THEN 0 ELSE round(tn / (tn + fp), 6) END AS specificity, round(((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) + (CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END)) / 2, 6) AS balanced_accuracy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"


@register("mx5_classification", v.with_sql(*SCORED, f"c AS (SELECT {_CONF.format(x='round(rule_score, 9)', t='0.5')} FROM scored)", select=f"SELECT tp, fp, tn, fn, {_MET} FROM c"))
def mx5_classification(spark, sf_dir):
    return m.classification_metrics(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x")


@register("mx6_brier", v.with_sql(*SCORED, select="SELECT round(avg((rule_score - label) ** 2), 6) AS brier FROM scored"))
def mx6_brier(spark, sf_dir):
    return m.brier(scored(spark, sf_dir), "label", "rule_score")


_REL = "rel AS (SELECT CAST(least(floor(round(rule_score, 9) * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(round(rule_score, 9)) AS mean_score, avg(label) AS observed FROM scored GROUP BY 1)"


@register("mx7_reliability", v.with_sql(*SCORED, _REL, select="SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed FROM range(10) AS b(bin) LEFT JOIN rel ON rel.bin = b.bin"))
def mx7_reliability(spark, sf_dir):
    return m.reliability(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x")


@register("mx7_ece", v.with_sql(*SCORED, _REL, select="SELECT round(sum(n * abs(mean_score - observed)) / sum(n), 6) AS ece FROM rel"))
def mx7_ece(spark, sf_dir):
    return m.ece(m.reliability(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x"))


_LONG = "l AS (SELECT unnest([variant, 'all']) AS scope, label, item, site_hit_fraction, site_distance, mouth_occlusion FROM items), u AS (SELECT scope, label, 'site_distance' AS feature, site_distance AS value FROM l UNION ALL SELECT scope, label, 'mouth_occlusion', mouth_occlusion FROM l)"


@register("mx8_proxy_benchmark", v.with_sql(v.ITEMS, _LONG, "r AS (SELECT scope, feature, label, value, rank() OVER (PARTITION BY scope, feature ORDER BY value) + (count(*) OVER (PARTITION BY scope, feature, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY scope, feature ORDER BY label) + (count(*) OVER (PARTITION BY scope, feature, label) - 1) / 2 AS rl FROM u WHERE value IS NOT NULL)",
    "g AS (SELECT scope, feature, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, sum(label * rv) AS s, corr(rv, rl) AS spearman, avg(CASE WHEN label = 1 THEN value END) AS mp, avg(CASE WHEN label = 0 THEN value END) AS mn FROM r GROUP BY ALL)",
    select="SELECT scope, feature, n_pos, n_neg, round(mp, 6) AS mean_positive, round(mn, 6) AS mean_negative, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc, round(spearman, 6) AS spearman FROM g"))
def mx8_proxy_benchmark(spark, sf_dir):
    return m.proxy_benchmark(v.items(spark, sf_dir), ["site_distance", "mouth_occlusion"], "label", "variant")


_FOLD = "f AS (SELECT variant, avg((rule_score - label) ** 2) AS brier, avg(rule_score) AS mean_score FROM scored GROUP BY variant)"


@register("mx9_fold_report", v.with_sql(*SCORED, _FOLD, select="SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT 'brier' AS metric, brier AS v FROM f UNION ALL SELECT 'mean_score', mean_score FROM f) GROUP BY metric"))
def mx9_fold_report(spark, sf_dir):
    d = scored(spark, sf_dir)
    f = m.brier(d, "label", "rule_score", ["variant"]).join(d.groupBy("variant").agg(F.avg("rule_score").alias("mean_score")), "variant")
    return m.fold_report(f, ["brier", "mean_score"])


_OVER = "(SELECT count(*) FROM ra JOIN rb USING (candidate) WHERE ra.rank <= {k} AND rb.rank <= {k})"


@register("mx10_compare_rankings", v.with_sql(*CONSENSUS, f"j AS (SELECT ra.candidate, ra.rank, rb.rank AS r2, ra.score, rb.score AS s2 FROM ra JOIN rb USING (candidate)), jr AS (SELECT {_AVG.format(c='rank')} AS a, {_AVG.format(c='r2')} AS b, {_AVG.format(c='score')} AS c, {_AVG.format(c='s2')} AS d FROM j)",
    select=f"SELECT (SELECT count(*) FROM j) AS n, round((SELECT corr(a, b) FROM jr), 6) AS spearman_rank, round((SELECT corr(c, d) FROM jr), 6) AS spearman_score, round(({_KENDALL}), 6) AS kendall, round({_OVER.format(k=3)} / 3, 6) AS overlap_3, round({_OVER.format(k=5)} / 5, 6) AS overlap_5"))
def mx10_compare_rankings(spark, sf_dir):
    return m.compare_rankings(*both(spark, sf_dir), [3, 5])


@register("st4_topk_overlap", v.with_sql(*CONSENSUS, select=f"SELECT 5::BIGINT AS k_used, {_OVER.format(k=5)} AS n_shared, round({_OVER.format(k=5)} / 5, 6) AS overlap, round({_OVER.format(k=5)} / (10 - {_OVER.format(k=5)}), 6) AS jaccard"))
def st4_topk_overlap(spark, sf_dir):
    return m.topk_overlap(*both(spark, sf_dir), 5).select(F.col("k_used").cast("long").alias("k_used"), "n_shared", "overlap", "jaccard")


_IMP = "mt AS (SELECT returnflag AS metric, b, n FROM (SELECT l_returnflag AS returnflag, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS b, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS n FROM lineitem GROUP BY 1))"


def _metric_tables(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    side = lambda s: d.filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg("l_discount").alias("value"))
    return side("F"), side("O")


@register("mx11_improvement", v.with_sql(_IMP, select="SELECT metric, round(b, 6) AS base, round(n, 6) AS new, round(n - b, 6) AS delta, round((n - b) / abs(b), 6) AS relative_delta FROM mt"))
def mx11_improvement(spark, sf_dir):
    return m.improvement(*_metric_tables(spark, sf_dir))


@register("mx12_interpret", v.with_sql(_IMP, select="SELECT metric, CASE WHEN s IS NULL THEN 'not_available' WHEN s > 1e-9 THEN 'improved' WHEN s < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM (SELECT metric, CASE WHEN metric = 'R' THEN b - n ELSE n - b END AS s FROM mt)"))
def mx12_interpret(spark, sf_dir):
    return m.interpret(m.improvement(*_metric_tables(spark, sf_dir)), ["R"]).select("metric", "verdict")


_GRID = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
_SWEEP = f"sw AS (SELECT threshold, {_CONF.format(x='round(rule_score, 9)', t='threshold')} FROM scored, (SELECT unnest({_GRID}::DOUBLE[]) AS threshold) GROUP BY threshold), sm AS (SELECT threshold, tp, fp, tn, fn, {_MET} FROM sw)"


@register("mx13_threshold_sweep", v.with_sql(*SCORED, _SWEEP, select="SELECT * FROM sm"))
def mx13_threshold_sweep(spark, sf_dir):
    return m.threshold_sweep(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x", _GRID)


@register("mx13_best_threshold", v.with_sql(*SCORED, _SWEEP, select="SELECT threshold, balanced_accuracy FROM sm ORDER BY balanced_accuracy DESC, f1 DESC, threshold LIMIT 1"))
def mx13_best_threshold(spark, sf_dir):
    return m.best_threshold(m.threshold_sweep(scored(spark, sf_dir).withColumn("x", F.round("rule_score", 9)), "label", "x", _GRID)).select("threshold", "balanced_accuracy")


@register("jn8_parameter_grid", v.with_sql(v.ITEMS, select="SELECT cutoff, candidate, count(*) AS n FROM items, (SELECT unnest([0.02, 0.05, 0.08]::DOUBLE[]) AS cutoff) WHERE site_distance <= cutoff GROUP BY ALL"))
def jn8_parameter_grid(spark, sf_dir):
    grid = spark.createDataFrame([(0.02,), (0.05,), (0.08,)], "cutoff double")
    return m.sweep(v.items(spark, sf_dir).select("candidate", "site_distance"), grid).filter("site_distance <= cutoff").groupBy("cutoff", "candidate").agg(F.count("*").alias("n"))


@register("ag7_zscore", v.with_sql(v.ITEMS, "f AS (SELECT avg(site_hit_fraction) AS m1, stddev_pop(site_hit_fraction) AS d1, avg(mouth_occlusion) AS m2, stddev_pop(mouth_occlusion) AS d2 FROM items)", select="SELECT item, round((site_hit_fraction - m1) / d1, 6) AS z1, round(greatest(-1, least(1, (mouth_occlusion - m2) / d2)) + CASE WHEN mouth_occlusion IS NULL THEN NULL ELSE 0 END, 6) AS z2 FROM items, f"))
def ag7_zscore(spark, sf_dir):
    d, cols = v.items(spark, sf_dir).select("item", "site_hit_fraction", "mouth_occlusion"), ["site_hit_fraction", "mouth_occlusion"]
    f = m.zscore_fit(d, cols)
    a, b = m.zscore_transform(d, f, cols[:1]), m.zscore_transform(d, f, cols[1:], limit=1.0)
    return a.select("item", F.col("z_site_hit_fraction").alias("z1")).join(b.select("item", F.col("z_mouth_occlusion").alias("z2")), "item")


@register("ag7_zscore_inverse", v.with_sql(v.ITEMS, select="SELECT item, round(site_hit_fraction, 6) AS x FROM items"))
def ag7_zscore_inverse(spark, sf_dir):
    d = v.items(spark, sf_dir).select("item", "site_hit_fraction")
    f = m.zscore_fit(d, ["site_hit_fraction"])
    return m.zscore_inverse(m.zscore_transform(d, f, ["site_hit_fraction"]), f, ["site_hit_fraction"]).select("item", F.col("x_site_hit_fraction").alias("x"))


@register("ag11_label_coverage", "SELECT count(toxic) AS n_valid, count(DISTINCT toxic) AS n_classes, CASE WHEN count(toxic) = 0 THEN 'no_valid' WHEN count(DISTINCT toxic) < 2 THEN 'degenerate' WHEN count(toxic) < 8 THEN 'compare_only' ELSE 'usable_for_calibration' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def ag11_label_coverage(spark, sf_dir):
    return m.label_coverage(table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "toxic")


@register("ag12_derive_labels", v.with_sql(v.ITEMS, "g AS (SELECT candidate, avg(label) AS mean_label, max(label) AS max_label FROM items GROUP BY candidate)", "h AS (SELECT *, CAST(mean_label >= 0.5 AS INTEGER) AS a, CAST(mean_label > (SELECT median(mean_label) FROM g) AS INTEGER) AS b FROM g)", select="SELECT candidate, round(mean_label, 6) AS mean_label, max_label, CASE WHEN (SELECT count(DISTINCT a) FROM h) > 1 THEN a ELSE b END AS label, CASE WHEN (SELECT count(DISTINCT a) FROM h) > 1 THEN 'mean_threshold' ELSE 'above_median' END AS rule FROM h"))
def ag12_derive_labels(spark, sf_dir):
    return m.derive_labels(v.items(spark, sf_dir))


@register("wn10_group_folds", v.with_sql(v.ITEMS, "g AS (SELECT candidate, avg(label) AS a, count(*) AS n FROM items GROUP BY candidate)", "p AS (SELECT candidate, (row_number() OVER (ORDER BY a DESC NULLS LAST, n DESC, md5(candidate || ':7')) - 1) AS p FROM g)", select="SELECT candidate, CAST(CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS INTEGER) AS fold FROM p"))
def wn10_group_folds(spark, sf_dir):
    """Folds of candidates, dealt in turn up and down."""
    return m.group_folds(v.items(spark, sf_dir), 5)


@register("wn11_group_split", v.with_sql(v.ITEMS, "g AS (SELECT DISTINCT candidate FROM items)", "p AS (SELECT candidate, row_number() OVER (ORDER BY md5(candidate || ':7'), candidate) AS p, count(*) OVER () AS n FROM g)", select="SELECT candidate, CASE WHEN p <= least(greatest(1, round(n * 0.2)), n - 1) THEN 'validation' ELSE 'train' END AS side FROM p"))
def wn11_group_split(spark, sf_dir):
    """Candidates for training or validation by a seeded hash."""
    return m.group_split(v.items(spark, sf_dir), 0.2)


@register("wn9_flag_topk", v.with_sql(*CONSENSUS, select="SELECT candidate, rank <= 3 AS in_top FROM ra"))
def wn9_flag_topk(spark, sf_dir):
    return ranking(spark, sf_dir).select("candidate", (F.col("rank") <= 3).alias("in_top"))


_SENS = """sens AS (SELECT wr, wa, wq, candidate, greatest(0, least(1, (1 - wr - wa) * mean_score + wr * rank_agreement + wa * score_alignment - wq * qc_risk)) AS s, consensus_rank FROM cons, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS wr), (SELECT unnest([0.05, 0.1, 0.15]::DOUBLE[]) AS wa), (SELECT unnest([0.0, 0.15, 0.3]::DOUBLE[]) AS wq)),
sr AS (SELECT *, row_number() OVER (PARTITION BY wr, wa, wq ORDER BY round(s, 9) DESC, candidate) AS r FROM sens)"""


@register("sc4_rank_sensitivity", v.with_sql(*CONSENSUS, _SENS, select="SELECT candidate, CAST(min(r) AS INTEGER) AS min_rank, CAST(max(r) AS INTEGER) AS max_rank, CAST(max(r) - min(r) AS INTEGER) AS rank_span, round(max(s) - min(s), 6) AS score_span, (max(r) - min(r) >= 3) OR (min(r) <= 5 AND max(r) > 5) OR round(max(s) - min(s), 9) >= 0.10 AS sensitive FROM sr GROUP BY candidate"))
def sc4_rank_sensitivity(spark, sf_dir):
    return search.sensitivity_by_candidate(search.rank_sensitivity(reviewed(spark, sf_dir), [0.1, 0.2, 0.3], [0.05, 0.1, 0.15], [0.0, 0.15, 0.3]), 5)


@register("sc4_scenario_agreement", v.with_sql(*CONSENSUS, _SENS, select="SELECT wr AS w_rank, wa AS w_align, wq AS w_qc, count_if(r <= 5 AND consensus_rank <= 5) AS n_shared, round(count_if(r <= 5 AND consensus_rank <= 5) / count_if(r <= 5 OR consensus_rank <= 5), 6) AS jaccard, round(corr(r, consensus_rank), 6) AS spearman FROM sr GROUP BY ALL"))
def sc4_scenario_agreement(spark, sf_dir):
    return search.sensitivity_by_scenario(search.rank_sensitivity(reviewed(spark, sf_dir), [0.1, 0.2, 0.3], [0.05, 0.1, 0.15], [0.0, 0.15, 0.3]), 5)


_TRIALS = [(0, 0.5, 0.3, 0.2), (1, 0.2, 0.5, 0.3), (2, 0.1, 0.1, 0.8)]


@register("sc7_weight_trials", v.with_sql(v.ITEMS, v.scaled_ctes("items", "z", ["site_hit_fraction", "anchor_hit_fraction", "energy_gb"]), f"t AS (SELECT * FROM (VALUES {', '.join(map(str, _TRIALS))}) AS x(trial, w1, w2, w3))",
    "s AS (SELECT trial, label, round((w1 * s_site_hit_fraction + w2 * s_anchor_hit_fraction + w3 * (1 - s_energy_gb)) / (w1 + w2 + w3), 9) AS x FROM z, t)", "r AS (SELECT trial, label, rank() OVER (PARTITION BY trial ORDER BY x) + (count(*) OVER (PARTITION BY trial, x) - 1) / 2 AS r FROM s)",
    "g AS (SELECT trial, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, sum(label * r) AS s FROM r GROUP BY trial)", select="SELECT trial, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM g"))
def sc7_weight_trials(spark, sf_dir):
    return search.weight_trials(v.items(spark, sf_dir), {"site_hit_fraction": 1, "anchor_hit_fraction": 1, "energy_gb": -1}, _TRIALS, "label")


_AGGW = [(0.5, 0.25, 0.2, 0.15), (0.4, 0.4, 0.1, 0.1), (0.6, 0.1, 0.3, 0.2)]


@register("sc8_aggregation_search", v.with_sql(v.ITEMS, v.SCORED, v.variants_ctes(), v.candidates_ctes(), f"w AS (SELECT * FROM (VALUES {', '.join(map(str, _AGGW))}) AS x(w1, w2, w3, w4))", "lab AS (SELECT candidate, avg(label) AS y FROM okitems GROUP BY candidate)",
    "f AS (SELECT w1, w2, w3, w4, y, w1 * mean_variant_score + w2 * best_variant_score + w3 * coalesce(consistency, 0) - w4 * std_variant_score AS s FROM candidates JOIN lab USING (candidate), w)",
    f"k AS (SELECT w1, w2, w3, w4, corr(a, b) AS rho FROM (SELECT w1, w2, w3, w4, rank() OVER (PARTITION BY w1, w2, w3, w4 ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY w1, w2, w3, w4, round(s, 9)) - 1) / 2 AS a, rank() OVER (PARTITION BY w1, w2, w3, w4 ORDER BY y) + (count(*) OVER (PARTITION BY w1, w2, w3, w4, y) - 1) / 2 AS b FROM f) GROUP BY ALL)",
    select="SELECT CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3, CAST(w4 AS DOUBLE) AS w4, round(rho, 6) AS spearman, round(greatest(0, least(1, (rho + 1) / 2)), 6) AS objective FROM k"))
def sc8_aggregation_search(spark, sf_dir):
    d = scoring.rule_score(scoring.keep_ok(v.ranked_items(spark, sf_dir, "label")))
    cands = scoring.rollup_candidates(scoring.rollup_variants(d))
    return search.aggregation_search(cands, d.groupBy("candidate").agg(F.avg("label").alias("y")), _AGGW)


@register("sc9_strategy_search", v.with_sql("t AS (SELECT l_suppkey AS trial, avg(l_discount) AS auc, avg(l_tax) AS rho FROM lineitem GROUP BY 1)", "g AS (SELECT trial, weight, metric, weight * auc * 10 + (1 - weight) * rho * 10 AS objective, CASE metric WHEN 'auc' THEN auc ELSE rho END AS value, auc >= (SELECT avg(auc) FROM t) AS feasible FROM t, (SELECT unnest([0.25, 0.75]::DOUBLE[]) AS weight), (SELECT unnest(['auc', 'rho']) AS metric))", select="SELECT weight, metric, trial, feasible, round(objective, 6) AS objective FROM (SELECT *, row_number() OVER (PARTITION BY weight, metric ORDER BY feasible DESC, round(objective, 9) DESC, round(value, 9) DESC, trial) AS r FROM g) WHERE r = 1"))
def sc9_strategy_search(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(F.avg("l_discount").alias("auc"), F.avg("l_tax").alias("rho"))
    return search.strategy_search(t, [0.25, 0.75], ["auc", "rho"])


_BASE = {"site_hit_fraction": 0.5, "anchor_hit_fraction": 0.3, "energy_gb": 0.2}
_DRAWN = search.draw_trials(list(_BASE.values()), 8)


@register("sc7_random_trials", v.with_sql(v.ITEMS, v.scaled_ctes("items", "z", list(_BASE)), f"t AS (SELECT * FROM (VALUES {', '.join(f'({t[0]}, {t[1]!r}::DOUBLE, {t[2]!r}::DOUBLE, {t[3]!r}::DOUBLE)' for t in _DRAWN)}) AS x(trial, w1, w2, w3))",
    "s AS (SELECT trial, label, round((w1 * s_site_hit_fraction + w2 * s_anchor_hit_fraction + w3 * (1 - s_energy_gb)) / (w1 + w2 + w3), 9) AS x FROM z, t)", "r AS (SELECT trial, label, rank() OVER (PARTITION BY trial ORDER BY x) + (count(*) OVER (PARTITION BY trial, x) - 1) / 2 AS r FROM s)",
    "g AS (SELECT trial, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, sum(label * r) AS s FROM r GROUP BY trial)", select="SELECT trial, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM g"))
def sc7_random_trials(spark, sf_dir):
    """Jittered and drawn weights around the base weights, all scored in one job."""
    return search.weight_trials(v.items(spark, sf_dir), {"site_hit_fraction": 1, "anchor_hit_fraction": 1, "energy_gb": -1}, _DRAWN, "label")


_GRID4 = [(a, b, c, d) for a in (0.4, 0.5, 0.6) for b in (0.15, 0.25) for c in (0.1, 0.2) for d in (0.05, 0.15)]
_LEAST = {"candidate_auc": 0.45, "rank_consistency": -0.05}
_TRIED = [
    v.ITEMS, v.SCORED, v.variants_ctes(), v.candidates_ctes(), f"w AS (SELECT * FROM (VALUES {', '.join(str(tuple(float(x) for x in t)) for t in _GRID4)}) AS x(w1, w2, w3, w4))",
    "lab AS (SELECT candidate, CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END AS y, round(avg(anchor_hit_fraction), 9) AS ref FROM okitems GROUP BY candidate)",
    "ia0 AS (SELECT label, rank() OVER (ORDER BY round(rule_score, 9)) + (count(*) OVER (PARTITION BY round(rule_score, 9)) - 1) / 2 AS r FROM scored)", "ia AS (SELECT (sum(label * r) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS item_auc FROM ia0)",
    "f AS (SELECT w1, w2, w3, w4, y, ref, round(w1 * mean_variant_score + w2 * best_variant_score + w3 * coalesce(consistency, 0) - w4 * std_variant_score, 9) AS s FROM candidates JOIN lab USING (candidate), w)",
    "rk AS (SELECT *, rank() OVER (PARTITION BY w1, w2, w3, w4 ORDER BY s) + (count(*) OVER (PARTITION BY w1, w2, w3, w4, s) - 1) / 2 AS a, rank() OVER (PARTITION BY w1, w2, w3, w4 ORDER BY ref) + (count(*) OVER (PARTITION BY w1, w2, w3, w4, ref) - 1) / 2 AS b FROM f)",
    "tr0 AS (SELECT w1, w2, w3, w4, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(y * a) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS candidate_auc, corr(a, b) AS rank_consistency FROM rk GROUP BY ALL)",
    "tr AS (SELECT *, 0.5 * coalesce(item_auc, 0) + 0.3 * coalesce(candidate_auc, 0) + 0.2 * greatest(0, least(1, (coalesce(rank_consistency, 0) + 1) / 2)) AS objective, coalesce(round(candidate_auc, 9) >= 0.45, FALSE) AND coalesce(round(rank_consistency, 9) >= -0.05, FALSE) AS feasible FROM tr0, ia)",
]
_W4 = "CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3, CAST(w4 AS DOUBLE) AS w4"
_PARTS = "round(item_auc, 6) AS item_auc, round(candidate_auc, 6) AS candidate_auc, round(rank_consistency, 6) AS rank_consistency, round(objective, 6) AS objective, feasible"


def _tried(spark, sf_dir):
    d = stage(scored(spark, sf_dir), "scored")
    cands = stage(scoring.rollup_candidates(scoring.rollup_variants(d)), "candidates")
    truth = stage(d.groupBy("candidate").agg((F.avg("label") >= 0.5).cast("int").alias("y"), F.round(F.avg("anchor_hit_fraction"), 9).alias("ref")), "truth")
    area = m.auc(d.withColumn("x", F.round("rule_score", 9)), "label", "x").select(F.col("auc").alias("item_auc"))
    return stage(search.aggregation_trials(cands, truth.select("candidate", "y"), truth.select("candidate", "ref"), _GRID4, area, least=_LEAST), "trials")


@register("sc8_constrained_trials", v.with_sql(*_TRIED, select=f"SELECT {_W4}, {_PARTS} FROM tr"))
def sc8_constrained_trials(spark, sf_dir):
    return _tried(spark, sf_dir)


@register("sc8_best_trial", v.with_sql(*_TRIED, select=f"SELECT {_W4}, {_PARTS}, (SELECT count_if(feasible) FROM tr) AS n_feasible, (SELECT count(*) FROM tr) AS n_trials, NOT feasible AS fallback FROM (SELECT * FROM tr ORDER BY feasible DESC, round(candidate_auc, 9) DESC NULLS LAST, round(objective, 9) DESC, round(candidate_auc, 9) DESC NULLS LAST, round(item_auc, 9) DESC, round(rank_consistency, 9) DESC NULLS LAST, w1, w2, w3, w4 LIMIT 1)"))
def sc8_best_trial(spark, sf_dir):
    return search.best_trial(_tried(spark, sf_dir), ["w1", "w2", "w3", "w4"], "candidate_auc")


@register("sc9_guarded_strategies", v.with_sql("t AS (SELECT l_suppkey AS trial, avg(l_discount) * 10 AS item_auc, avg(l_quantity) / 50 AS candidate_auc, avg(l_tax) * 20 - 1 AS rank_consistency FROM lineitem GROUP BY 1)",
    "g AS (SELECT *, coalesce(round(candidate_auc, 9) >= 0.52 - 0.01 - 1e-12, FALSE) AS feasible, 0.5 * item_auc + 0.3 * candidate_auc + rank_weight * greatest(0, least(1, (rank_consistency + 1) / 2)) AS objective FROM t, (SELECT unnest([0.0, 0.1, 0.3]::DOUBLE[]) AS rank_weight), (SELECT unnest(['objective', 'candidate_auc', 'rank_consistency']) AS selection))",
    select="SELECT rank_weight, selection, trial, feasible, NOT feasible AS fallback, round(objective, 6) AS objective, round(item_auc, 6) AS item_auc, round(candidate_auc, 6) AS candidate_auc, round(rank_consistency, 6) AS rank_consistency FROM (SELECT *, row_number() OVER (PARTITION BY rank_weight, selection ORDER BY feasible DESC, round(CASE selection WHEN 'objective' THEN objective WHEN 'candidate_auc' THEN candidate_auc ELSE rank_consistency END, 9) DESC, round(objective, 9) DESC, round(candidate_auc, 9) DESC, round(item_auc, 9) DESC, round(rank_consistency, 9) DESC, trial) AS r FROM g) WHERE r = 1"))
def sc9_guarded_strategies(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg((F.avg("l_discount") * 10).alias("item_auc"), (F.avg("l_quantity") / 50).alias("candidate_auc"), (F.avg("l_tax") * 20 - 1).alias("rank_consistency"))
    return search.guarded_strategies(t, [0.0, 0.1, 0.3], ["objective", "candidate_auc", "rank_consistency"], baseline={"candidate_auc": 0.52}, tolerance={"candidate_auc": 0.01})
