"""Sweeps and searches: parameters are a small broadcast table, data is read once."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, ratio
from screenspark.operators.metrics import auc, spearman, sweep
from screenspark.operators.scoring import robust_scale
from screenspark.plans.staging import stage

SCENARIO = ["w_rank", "w_align", "w_qc"]


def rank_sensitivity(consensus: DataFrame, w_rank: list[float], w_align: list[float], w_qc: list[float]) -> DataFrame:
    """Every candidate re-scored and re-ranked in every scenario of weights."""
    grid = consensus.sparkSession.createDataFrame(list(product(w_rank, w_align, w_qc)), "w_rank double, w_align double, w_qc double")
    s = (1 - F.col("w_rank") - F.col("w_align")) * F.col("mean_score") + F.col("w_rank") * F.col("rank_agreement") + F.col("w_align") * F.col("score_alignment") - F.col("w_qc") * F.col("qc_risk")
    d = sweep(consensus, grid).withColumn("s", clip(s, 0, 1))
    return d.withColumn("r", F.row_number().over(Window.partitionBy(*SCENARIO).orderBy(F.desc(F.round("s", 9)), "candidate"))).select(*SCENARIO, "candidate", "s", "r", "consensus_rank")


def sensitivity_by_candidate(runs: DataFrame, top_n: int) -> DataFrame:
    """Spans of rank and score over all scenarios, and whether a candidate is sensitive to the weights."""
    g = runs.groupBy("candidate").agg(F.min("r").alias("min_rank"), F.max("r").alias("max_rank"), (F.max("s") - F.min("s")).alias("score_span")).withColumn("rank_span", F.col("max_rank") - F.col("min_rank"))
    crossed = (F.col("min_rank") <= top_n) & (F.col("max_rank") > top_n)
    return g.withColumn("sensitive", (F.col("rank_span") >= 3) | crossed | (F.round("score_span", 9) >= 0.10))


def sensitivity_by_scenario(runs: DataFrame, top_n: int) -> DataFrame:
    """Agreement of each scenario with the base ranking."""
    a, b = F.col("r") <= top_n, F.col("consensus_rank") <= top_n
    return runs.groupBy(*SCENARIO).agg(F.count_if(a & b).alias("n_shared"), (F.count_if(a & b) / F.count_if(a | b)).alias("jaccard"), F.corr("r", "consensus_rank").alias("spearman"))


def weight_trials(items: DataFrame, features: dict[str, int], trials: list[tuple], label: str) -> DataFrame:
    """AUC of every trial of feature weights (trial, w1, w2, ...), all in one job over the scaled items.

    Only the label and the features are staged, and equal rows meet the trials once, with their number.
    """
    cols = list(features)
    names = [f"w{i + 1}" for i in range(len(cols))]
    table = items.sparkSession.createDataFrame([(int(t[0]), *map(float, t[1:])) for t in trials], "trial int, " + ", ".join(f"{n} double" for n in names))
    scaled = robust_scale(stage(items.select(F.col(label).alias("label"), *cols), "trials"), cols)
    d = sweep(scaled.groupBy("label", *(f"s_{c}" for c in cols)).agg(F.count("*").alias("_rows")), table)
    terms = [(F.col(f"s_{c}") if features[c] > 0 else 1 - F.col(f"s_{c}"), F.col(n)) for c, n in zip(cols, names, strict=True)]
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in terms), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in terms), F.lit(0.0))
    return auc(d.withColumn("x", F.when(weight > 0, F.round(top / weight, 9))), "label", "x", ["trial"], "_rows")


def aggregation_search(candidates: DataFrame, labels: DataFrame, weights: list[tuple]) -> DataFrame:
    """Rank correlation with the labels for every set of roll-up weights; variants are rolled up once."""
    names = ["w1", "w2", "w3", "w4"]
    grid = candidates.sparkSession.createDataFrame([tuple(map(float, w)) for w in weights], ", ".join(f"{n} double" for n in names))
    s = F.col("w1") * F.col("mean_variant_score") + F.col("w2") * F.col("best_variant_score") + F.col("w3") * F.coalesce("consistency", F.lit(0.0)) - F.col("w4") * F.col("std_variant_score")
    d = sweep(candidates.join(labels, "candidate"), grid).withColumn("s", F.round(s, 9)).select(*names, "s", "y")
    out = spearman(d, "s", "y", names).drop("n")
    return out.withColumn("objective", F.coalesce(clip((F.col("spearman") + 1) / 2, 0, 1), F.lit(0.0)))


def strategy_search(trials: DataFrame, weights: list[float], metrics: list[str]) -> DataFrame:
    """The best trial for every objective weight and selection metric; trials not below the mean AUC come first."""
    spark = trials.sparkSession
    grid = spark.createDataFrame([(float(w), m) for w in weights for m in metrics], "weight double, metric string")
    base = trials.agg(F.avg("auc").alias("_base"))
    d = sweep(trials.crossJoin(F.broadcast(base)), grid)
    d = d.withColumn("objective", F.col("weight") * F.col("auc") * 10 + (1 - F.col("weight")) * F.col("rho") * 10).withColumn("_v", F.when(F.col("metric") == "auc", F.col("auc")).otherwise(F.col("rho"))).withColumn("feasible", F.col("auc") >= F.col("_base"))
    w = Window.partitionBy("weight", "metric").orderBy(F.desc("feasible"), F.desc(F.round("objective", 9)), F.desc(F.round("_v", 9)), "trial")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("weight", "metric", "trial", "feasible", "objective")


def draw_trials(base: list[float], n: int, seed: int = 7, sigma: float = 0.35) -> list[tuple]:
    """Trials (number, weights that sum to 1): the base weights first, then in turn log-normal jitter of them and Dirichlet draws around them.

    A short table made on the driver; its size is that of the search, not of the data.
    """
    rng, w = np.random.default_rng(seed), np.array(base, float) / sum(base)
    spread = np.maximum(w * max(2.0, len(w)), 0.2)
    out = [w]
    while len(out) < n:
        draw = w * np.exp(rng.normal(0.0, sigma, len(w))) if len(out) % 2 else rng.dirichlet(spread)
        out.append(draw / draw.sum())
    return [(i, *(round(float(x), 6) for x in t)) for i, t in enumerate(out)]


def objective(weights: tuple[float, float, float | Column], item_auc: Column, candidate_auc: Column, consistency: Column) -> Column:
    """Weighted sum of two areas and of a rank correlation taken to 0..1; a missing part is 0."""
    r = clip((F.coalesce(consistency, F.lit(0.0)) + 1) / 2, 0, 1)
    parts = zip(weights, (F.coalesce(item_auc, F.lit(0.0)), F.coalesce(candidate_auc, F.lit(0.0)), r), strict=True)
    return sum((F.greatest(F.lit(0.0), F.lit(w) if isinstance(w, (int, float)) else w) * x for w, x in parts), F.lit(0.0))


def aggregation_trials(candidates: DataFrame, labels: DataFrame, reference: DataFrame, weights: list[tuple], item_auc: DataFrame, mix: tuple[float, float, float] = (0.5, 0.3, 0.2), least: dict[str, float] | None = None) -> DataFrame:
    """Every set of roll-up weights with candidate AUC, rank correlation with a reference, objective and whether it meets the ``least`` values.

    ``labels`` has candidate and y (0 or 1), ``reference`` candidate and ref,
    ``item_auc`` one row.  Variants are rolled up once for all trials.
    """
    names = ["w1", "w2", "w3", "w4"]
    grid = candidates.sparkSession.createDataFrame([tuple(map(float, w)) for w in weights], ", ".join(f"{n} double" for n in names))
    s = F.col("w1") * F.col("mean_variant_score") + F.col("w2") * F.col("best_variant_score") + F.col("w3") * F.coalesce("consistency", F.lit(0.0)) - F.col("w4") * F.col("std_variant_score")
    d = sweep(candidates.join(labels, "candidate", "left").join(reference, "candidate", "left"), grid).withColumn("s", F.round(s, 9)).select(*names, "s", "y", "ref")
    out = grid.join(auc(d, "y", "s", names).select(*names, F.col("auc").alias("candidate_auc")), names, "left").join(spearman(d, "s", "ref", names, "rank_consistency").drop("n"), names, "left").join(item_auc.select("item_auc"))
    out = out.withColumn("objective", objective(mix, F.col("item_auc"), F.col("candidate_auc"), F.col("rank_consistency")))
    meets = F.lit(True)
    for name, value in (least or {}).items():
        meets = meets & F.coalesce(F.round(name, 9) >= value, F.lit(False))
    return out.withColumn("feasible", meets)


ORDER = ("objective", "candidate_auc", "item_auc", "rank_consistency")


def _ties(first: str) -> list[Column]:
    return [F.desc_nulls_last(F.round(c, 9)) for c in (first, *ORDER)]


def best_trial(trials: DataFrame, keys: list[str], selection: str = "objective") -> DataFrame:
    """The best feasible trial, or the best of all if none is (``fallback``), with the numbers of feasible and of all trials."""
    n = trials.agg(F.count_if("feasible").alias("n_feasible"), F.count("*").alias("n_trials"))
    best = trials.orderBy(F.desc("feasible"), *_ties(selection), *keys).limit(1)
    return best.crossJoin(n).withColumn("fallback", ~F.col("feasible"))


def guarded_strategies(trials: DataFrame, rank_weights: list[float], selections: list[str], mix: tuple[float, float] = (0.5, 0.3), baseline: dict[str, float] | None = None, tolerance: dict[str, float] | None = None) -> DataFrame:
    """The best trial for every rank weight and selection metric; trials that fall below a baseline by more than the tolerance only count if all do."""
    grid = trials.sparkSession.createDataFrame([(float(w), m) for w in rank_weights for m in selections], "rank_weight double, selection string")
    guard = F.lit(True)
    for name, value in (baseline or {}).items():
        guard = guard & F.coalesce(F.round(name, 9) >= value - (tolerance or {}).get(name, 0.0) - 1e-12, F.lit(False))
    d = sweep(trials, grid).withColumn("feasible", guard).withColumn("objective", objective((*mix, F.col("rank_weight")), F.col("item_auc"), F.col("candidate_auc"), F.col("rank_consistency")))
    d = d.withColumn("_first", F.coalesce(*(F.when(F.col("selection") == c, F.col(c)) for c in ORDER)))
    w = Window.partitionBy("rank_weight", "selection").orderBy(F.desc("feasible"), *_ties("_first"), "trial")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("rank_weight", "selection", "trial", "feasible", (~F.col("feasible")).alias("fallback"), "objective", "item_auc", "candidate_auc", "rank_consistency")


def site_sweep(predicted: DataFrame, truth: DataFrame, parameters: list[float]) -> DataFrame:
    """Accuracy of the keys at every parameter value: ``predicted`` has structure, key and the least ``value`` at which the key is predicted."""
    grid = truth.sparkSession.createDataFrame([(float(x),) for x in parameters], "parameter double")
    t = truth.select("structure", "key", F.lit(True).alias("true")).distinct()
    both = predicted.select("structure", "key", "value").join(t, ["structure", "key"], "left")
    hits = sweep(both, grid).filter("value <= parameter").groupBy("structure", "parameter").agg(F.count("*").alias("n_predicted"), F.count("true").alias("n_hit"))
    every = sweep(t.groupBy("structure").agg(F.count("*").alias("n_truth")), grid).join(hits, ["structure", "parameter"], "left").fillna(0, ["n_predicted", "n_hit"])
    p, t_, h = F.col("n_predicted"), F.col("n_truth"), F.col("n_hit")
    return every.withColumn("coverage", h / t_).withColumn("precision", ratio(h, p)).withColumn("jaccard", h / (p + t_ - h)).withColumn("f1", 2 * h / (p + t_))
