"""Pseudo labels, preparation, training, inference and grouped cross-validation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.functions.columns import clip
from screenspark.operators import metrics, network, scoring
from screenspark.operators.quantiles import exact_quantiles
from screenspark.plans.staging import stage, staged

#: Sign and weight of each feature of the pseudo label.
PSEUDO_FEATURES = {
    "site_hit_fraction": (1, 0.16), "anchor_hit_fraction": (1, 0.14), "mouth_occlusion": (1, 0.12), "mouth_axis_block": (1, 0.05), "mouth_aperture_block": (1, 0.05), "mouth_clearance": (-1, 0.03),
    "occupancy_delta": (1, 0.11), "overlap_score": (1, 0.11), "path_score": (1, 0.06), "path_fraction": (1, 0.05), "path_bottleneck": (1, 0.04), "path_exit_fraction": (1, 0.04),
    "path_clearance": (-1, 0.03), "site_distance": (-1, 0.08), "site_accuracy": (1, 0.06), "docking_score": (-1, 0.06), "energy_pb_a": (-1, 0.05), "energy_pb_b": (-1, 0.05), "energy_gb": (-1, 0.05), "interface_energy": (-1, 0.03),
}


def pseudo_labels(items: DataFrame, mode: str = "top_fraction", value: float = 0.3) -> DataFrame:
    """``pseudo_score`` and ``pseudo_label``: the top share by mean ranks, a fixed threshold, or a quantile."""
    d = scoring.rule_score(items, PSEUDO_FEATURES, "pseudo_score")
    if mode == "top_fraction":
        d = metrics.avg_rank(d.withColumn("_score", F.round("pseudo_score", 9)), "_score", "_r")
        return d.withColumn("pseudo_label", F.when(F.col("_r_pct") >= 1 - value, 1.0).otherwise(0.0)).drop("_score", "_r", "_r_pct")
    if mode == "quantile":
        (cut,) = exact_quantiles(d, ["pseudo_score"], [value])["pseudo_score"]
        return d.withColumn("pseudo_label", F.when(F.col("pseudo_score") >= F.lit(cut), 1.0).otherwise(0.0))
    return d.withColumn("pseudo_label", F.when(F.col("pseudo_score") >= value, 1.0).otherwise(0.0))


def fit_prep(train: DataFrame, cols: list[str]) -> DataFrame:
    """Medians, means and sample deviations of the training rows, as one row."""
    med = {c: q[0] if q[0] is not None else 0.0 for c, q in exact_quantiles(train, cols, [0.5]).items()}
    filled = train.select(*(F.coalesce(c, F.lit(med[c])).alias(c) for c in cols))
    return metrics.zscore_fit(filled, cols, sample=True).select("*", *(F.lit(med[c]).alias(f"md_{c}") for c in cols))


def apply_prep(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Median-filled, standardised columns ``z_<col>``."""
    d = df.crossJoin(F.broadcast(fitted))
    z = [((F.coalesce(c, f"md_{c}") - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(f"z_{c}") for c in cols]
    return d.select(*df.columns, *z)


def train(prepared: DataFrame, cols: list[str], label: str = "label", soft: str | None = None, kind: str = "logistic", seed: int = 7):
    """A pose classifier over ``z_<col>``; classes are weighted to balance.

    With ``soft``, a row counts for both classes by its soft target.  ``kind`` is
    ``logistic`` or ``perceptron`` (two hidden layers, weights and all).
    """
    d = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(prepared)
    if soft:
        both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col(soft).alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col(soft)).alias("w"))))
        d = d.select("features", both.alias("_x")).select("features", F.col("_x.y").alias("y"), F.col("_x.w").alias("w")).filter("w > 0")
    else:
        d = d.filter(F.col(label).isin(0, 1)).select("features", F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"))
    total = d.agg(F.sum(F.when(F.col("y") == 1, F.col("w"))).alias("_p"), F.sum("w").alias("_t"))
    d = d.crossJoin(F.broadcast(total)).withColumn("w", F.when(F.col("y") == 1, F.col("w") * F.greatest(F.lit(1.0), (F.col("_t") - F.col("_p")) / F.col("_p"))).otherwise(F.col("w")))
    if kind == "perceptron":
        return network.train_network(d.select(vector_to_array("features").alias("x"), "y", "w"), len(cols), seed=seed)
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50).fit(d)


def predict(model, prepared: DataFrame, cols: list[str]) -> DataFrame:
    """``pred_prob`` and, for a logistic model, ``pred_logit`` and the three largest contributions."""
    if isinstance(model, network.Network):
        return network.apply_network(model, prepared, [f"z_{c}" for c in cols], "pred_prob")
    d = model.transform(VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(prepared))
    d = d.withColumn("pred_prob", vector_to_array("probability")[1])
    keep = [*prepared.columns, "pred_prob"]
    if hasattr(model, "coefficients"):
        parts = {c: F.col(f"z_{c}") * float(w) for c, w in zip(cols, model.coefficients.toArray(), strict=True)}
        d = d.withColumn("pred_logit", vector_to_array("rawPrediction")[1]).withColumn("top_contributions", scoring.top_components(parts))
        keep += ["pred_logit", "top_contributions"]
    return d.select(*keep)


def fold_quantiles(d: DataFrame, sides: list[tuple[bool, list[str]]], probs: list[float], n: int) -> list[list[dict[str, list[float | None]]]]:
    """Quantiles of the training (True) or test rows of every fold, of all folds and sides in the same passes."""
    names, values = {}, []
    for i, (training, cols) in enumerate(sides):
        for fold in range(n):
            rows = F.col("fold") != fold if training else F.col("fold") == fold
            for j, c in enumerate(cols):
                names[i, fold, c] = f"q{i}_{fold}_{j}"
                values.append(F.when(rows, F.col(c)).alias(names[i, fold, c]))
    found = exact_quantiles(d.select(*values), list(names.values()), probs)
    return [[{c: found[names[i, fold, c]] for c in cols} for fold in range(n)] for i, (_, cols) in enumerate(sides)]


def fit_folds(d: DataFrame, cols: list[str], n: int) -> list[DataFrame]:
    """:func:`fit_prep` of the training rows of every fold, in the same passes."""
    (medians,) = fold_quantiles(d, [(True, cols)], [0.5], n)
    filled, parts = [{c: m[c][0] if m[c][0] is not None else 0.0 for c in cols} for m in medians], []
    for fold, med in enumerate(filled):
        parts += [F.when(F.col("fold") != fold, F.coalesce(F.col(c), F.lit(med[c]))).alias(f"{fold}_{j}") for j, c in enumerate(cols)]
    row = metrics.zscore_fit(d.select(*parts), [f"{fold}_{j}" for fold in range(n) for j in range(len(cols))], sample=True).first()
    out = []
    for fold, med in enumerate(filled):
        fitted = [F.lit(row[f"{x}_{fold}_{j}"]).cast("double").alias(f"{x}_{c}") for x in "md" for j, c in enumerate(cols)]
        out.append(d.sparkSession.range(1).select(*fitted, *(F.lit(med[c]).alias(f"md_{c}") for c in cols)))
    return out


def cross_validate(items: DataFrame, cols: list[str], label: str = "label", n: int = 3, seed: int = 7, fit_on: str = "test", k: int = 3) -> DataFrame:
    """Metrics of every fold of a grouped cross-validation, of items and of candidates.

    No candidate is on both sides.  Items: AUC of the model and of the rule, and the
    model's Brier score.  Candidates: both scores are rolled up to candidates (the ``k``
    top items of a variant), whose AUC is taken against labels from the fold's items.
    The rule's scaling is fitted on the test rows, as it is in use, or on the training
    rows (``fit_on`` train).  The driver loops over the folds to train only; preparation,
    bounds, scores, roll-ups and metrics of all folds take the same passes, as a
    candidate is a test row of one fold.
    """
    items = staged(items, "items")
    d = stage(items.join(metrics.group_folds(items, n, seed, label=label), "candidate"), "folds")
    rule = [c for c in scoring.RULE_FEATURES if c in d.columns]
    geo = [c for c in scoring.GEOMETRY_WEIGHTS if c in d.columns]
    rule_bounds, geo_bounds = fold_quantiles(d, [(True, rule), (False, geo)], [0.01, 0.99], n) if fit_on == "train" else 2 * fold_quantiles(d, [(False, list(dict.fromkeys([*rule, *geo])))], [0.01, 0.99], n)
    p = None
    for fold, fitted in enumerate(fit_folds(d, cols, n)):
        model = train(apply_prep(d.filter(F.col("fold") != fold), fitted, cols), cols, label)
        part = predict(model, apply_prep(d.filter(F.col("fold") == fold), fitted, cols), cols).select(*d.columns, "pred_prob")
        part = part.select("*", *(scoring.scaled(c, *rule_bounds[fold][c]).alias(f"_s_{c}") for c in rule), *(scoring.scaled(c, *geo_bounds[fold][c]).alias(f"s_{c}") for c in geo))
        part = part.withColumn("_raw", scoring.rule_mean(scoring.RULE_FEATURES, rule, "_s_")).drop(*(f"_s_{c}" for c in rule))
        p = part if p is None else p.unionByName(part)
    p = stage(p, "scored")
    medians = [0.5] * n
    if not p.filter(F.col("_raw").isNull()).isEmpty():
        medians = [0.5 if q["_raw"][0] is None else q["_raw"][0] for q in fold_quantiles(p, [(False, ["_raw"])], [0.5], n)[0]]
    p = p.withColumn("rule_score", clip(F.coalesce("_raw", F.element_at(F.array(*map(F.lit, medians)), F.col("fold") + 1)), 0, 1)).drop("_raw")
    by = ["fold"]
    out = metrics.auc(p, label, "pred_prob", by).select("fold", "n_pos", "n_neg", F.col("auc").alias("model_auc")).join(metrics.auc(p, label, "rule_score", by).select("fold", F.col("auc").alias("rule_auc")), "fold").join(metrics.brier(p, label, "pred_prob", by), "fold")
    means = stage(p.groupBy("candidate", "fold").agg(F.avg(label).alias("mean_label"), F.max(label).alias("max_label")), "means")
    truth = None
    for fold in range(n):  # tables of candidate size
        part = metrics.labels_of_means(means.filter(F.col("fold") == fold).drop("fold")).select("candidate", F.col("label").alias("truth"), F.lit(fold).alias("fold"))
        truth = part if truth is None else truth.unionByName(part)
    for name, score in (("model", "pred_prob"), ("rule", "rule_score")):
        ranked = scoring.rollup_candidates(scoring.rollup_variants(p, k, score, is_scaled=True)).join(truth, "candidate")
        of = metrics.auc(ranked, "truth", "final_score", by)
        out = out.join(of.select("fold", F.col("auc").alias(f"candidate_{name}_auc"), *([(F.col("n_pos") + F.col("n_neg")).alias("n_candidates")] if name == "model" else [])), "fold", "left")
    return out.withColumn("delta", F.col("model_auc") - F.col("rule_auc")).withColumn("candidate_delta", F.col("candidate_model_auc") - F.col("candidate_rule_auc"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean, sample deviation, least and greatest value of every metric over the folds: ``metric, mean, std, min, max``."""
    names = [c for c in folds.columns if c != "fold"]
    long = folds.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
