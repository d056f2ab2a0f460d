"""Ranks and evaluation metrics; each is an aggregate over a scored table, by group if asked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import ratio
from screenspark.operators.quantiles import exact_quantiles
from screenspark.plans.staging import stage


#: Slices of a value range, in which running counts are taken side by side.
SLICES = 32


def running_counts(counts: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``counts`` (by, value, _n) with ``_below``, the rows of lesser values in the group, and ``_total``.

    The values are cut into slices at approximate quantiles; sums of slices, which are
    few, give what lies before a slice, and each slice is summed by itself.
    """
    by = list(by)
    counts = stage(counts, "counts")
    cuts = counts.agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 1000)).first()[0] or []
    place = F.lit(0)
    for cut in sorted(set(cuts)):
        place = place + (F.col(value) >= F.lit(cut)).cast("int")
    cut_up = counts.withColumn("_slice", place)
    one = Window.partitionBy(*(by or [F.lit(0)]))
    sums = cut_up.groupBy(*by, "_slice").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(one.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_s").over(one)).drop("_s")
    inside = F.sum("_n").over(Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    joined = cut_up.join(sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_slice").alias("_at"), "_before", "_total"), on=[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_slice") == F.col("_at")])
    return joined.withColumn("_below", F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_slice", "_at", "_before", *(f"_by_{c}" for c in by))


def value_ranks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``by, value, _avg_rank, _min_rank_desc``: ranks of the distinct values, from counts of each value.

    Counts are combined before the shuffle, and the running sums go by slices of the
    values, so no task holds all of them.
    """
    c = running_counts(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), value, by)
    return c.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias("_avg_rank"), (F.col("_total") - F.col("_below") - F.col("_n") + 1).alias("_min_rank_desc"), "_total")


def min_rank(df: DataFrame, value: str, out: str = "min_rank", by: list[str] = ()) -> DataFrame:
    """Descending rank in which ties share the best place; NULL stays NULL."""
    return df.join(value_ranks(df, value, by).select(*by, value, F.col("_min_rank_desc").alias(out)), [*by, value], "left")


def avg_rank(df: DataFrame, value: str, out: str = "avg_rank", by: list[str] = ()) -> DataFrame:
    """Ascending rank in which ties share their mean place, and it as a share of the rows (``<out>_pct``)."""
    r = value_ranks(df, value, by).select(*by, value, F.col("_avg_rank").alias(out), (F.col("_avg_rank") / F.col("_total")).alias(f"{out}_pct"))
    return df.join(r, [*by, value], "left")


def auc(df: DataFrame, label: str, score: str, by: list[str] = (), rows: str | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks on ties; NULL without both classes. A row stands for ``rows`` equal ones."""
    d = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    n = F.col(rows) if rows else F.lit(1).cast("long")
    c = d.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, n).otherwise(0)).alias("_p"), F.sum(n).alias("_n"))
    c = running_counts(c, score, by).withColumn("_r", F.col("_below") + (F.col("_n") + 1) / 2)
    out = c.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_r")).alias("_s"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"))
    area = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area)).drop("_s")


def pearson(df: DataFrame, x: str, y: str, by: list[str] = (), out: str = "pearson") -> DataFrame:
    """Pearson correlation over complete pairs; NULL for fewer than two or no variance."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = d.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"))
    return a.select(*by, "n", F.when((F.col("n") >= 2) & (F.col("_vx") > 1e-24) & (F.col("_vy") > 1e-24), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = (), out: str = "spearman") -> DataFrame:
    """Pearson of mean ranks over complete pairs."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    return pearson(avg_rank(avg_rank(d, x, "_rx", by), y, "_ry", by), "_rx", "_ry", by, out)


def slice_of(value: str, cuts: list[float]) -> Column:
    """Number of a slice of values: 2 n between the cuts n - 1 and n, 2 n + 1 at cut n itself, which is one value."""
    place = F.lit(0)
    for cut in cuts:
        place = place + F.when(F.col(value) > F.lit(cut), 2).when(F.col(value) == F.lit(cut), 1).otherwise(0)
    return place


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Weight of the pairs i < j of a sequence with y[i] > y[j]; halves are counted, sorted and merged."""
    if len(y) <= 64:
        return int(np.triu((y[:, None] > y[None, :]) * np.multiply.outer(w.astype(object) if w.max(initial=0) > 2**20 else w, w), 1).sum())
    half = len(y) // 2
    left, right = np.argsort(y[:half], kind="stable"), y[half:]
    below = np.append(0, np.cumsum(w[:half][left]))
    greater = below[-1] - below[np.searchsorted(y[:half][left], right, side="right")]
    across = int(greater.astype(object) @ w[half:].astype(object)) if below[-1] > 2**30 else int(greater @ w[half:])
    return inversions(y[:half], w[:half]) + inversions(right, w[half:]) + across


def kendall(df: DataFrame, key: str, x: str, y: str, slice_rows: int = 100_000) -> DataFrame:
    """Concordant less discordant pairs over the pairs untied in both; NULL without any. Rows with a NULL do not count.

    Equal rows are counted first.  Discordant pairs are inversions of y along x: they
    are counted within slices of x, within slices of y between rows of different slices
    of x, and for all other pairs from the sizes of the cells of both, so no pair is
    ever made.  A value that many rows share is a slice of its own, in which there is
    nothing to count.  All counts are exact.
    """
    counts = stage(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")), "pairs")
    rows = counts.count()
    parts = max(1, min(256, -(-rows // slice_rows)))
    cuts = {c: sorted(set(counts.agg(F.percentile_approx(c, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else [] for c in "xy"}
    cells = counts.withColumn("sx", slice_of("x", cuts["x"])).withColumn("sy", slice_of("y", cuts["y"]))

    def count(order: list[str]):
        def run(table: pa.Table) -> pa.Table:
            t = table.sort_by([(c, "ascending") for c in order])
            return pa.table({"n": [str(inversions(t.column("y").to_numpy(), t.column("n").to_numpy()))]})

        return run

    # Within a slice of x; then within a slice of y, where rows of one slice of x stand in the order of y and so add nothing.
    inside = [cells.filter("sx % 2 = 0").groupBy("sx").applyInArrow(count(["x", "y"]), "n string"), cells.filter("sy % 2 = 0").groupBy("sy").applyInArrow(count(["sx", "y"]), "n string")]
    found = sum(int(r["n"]) for part in inside for r in part.collect())
    grid = np.zeros((2 * parts, 2 * parts), object)
    for r in cells.groupBy("sx", "sy").agg(F.sum("n").alias("n")).collect():
        grid[r["sx"], r["sy"]] = r["n"]
    before = np.zeros(2 * parts, object)  # rows of earlier slices of x, by slice of y
    for row in grid:
        greater = np.append(np.cumsum(before[::-1])[::-1][1:], 0)
        found += int((greater * row).sum())
        before = before + row
    exact = lambda c: c.cast("decimal(38,0)")
    pairs = lambda c: (exact(c) * (exact(c) - 1) / 2).cast("decimal(38,0)")
    same = [counts.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).first()[0] or 0 for by in ([], ["x"], ["y"], ["x", "y"])]
    untied = int(same[0] - same[1] - same[2] + same[3])
    value = (untied - 2 * found) / untied if untied else None
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias("kendall"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    return [F.count_if((label == 1) & predicted).alias("tp"), F.count_if((label == 0) & predicted).alias("fp"), F.count_if((label == 0) & ~predicted).alias("tn"), F.count_if((label == 1) & ~predicted).alias("fn")]


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float | Column = 0.5, by: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, specificity, balanced accuracy and F1 at a threshold; 0 / 0 is 0."""
    d = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    out = d.groupBy(*by).agg(*confusion(F.col(label), F.col(score) >= threshold))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = out.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn, 0.0)).withColumn("precision", ratio(tp, tp + fp, 0.0)).withColumn("recall", ratio(tp, tp + fn, 0.0)).withColumn("specificity", ratio(tn, tn + fp, 0.0))
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, 0.0))


def brier(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    return df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal bins of the score, the last one closed; empty bins stay."""
    d = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    b = d.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(b, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(curve: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return curve.agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))), F.sum("n")).alias("ece"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion metrics at every threshold, in one pass over the rows."""
    grid = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return classification_metrics(sweep(df, grid), label, score, F.col("threshold"), ["threshold"])


def sweep(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every row of a small parameter grid, which is broadcast."""
    return df.crossJoin(F.broadcast(grid))


def best_threshold(sweep_table: DataFrame) -> DataFrame:
    """The row of the highest balanced accuracy; ties go to F1, then the lower threshold."""
    return sweep_table.orderBy(F.desc("balanced_accuracy"), F.desc("f1"), "threshold").limit(1)


def proxy_benchmark(df: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """AUC, Spearman and class means of every feature on its own, for each fold and overall."""
    long = df.select(F.explode(F.array(F.col(fold).cast("string"), F.lit("all"))).alias("scope"), F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("f")).select("scope", "label", "f.feature", "f.value")
    by = ["scope", "feature"]
    means = long.groupBy(*by).agg(F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("mean_positive"), F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("mean_negative"))
    return means.join(auc(long, "label", "value", by), by, "left").join(spearman(long, "value", "label", by).drop("n"), by, "left")


def fold_report(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, deviation (population), minimum and maximum of metrics over folds."""
    long = folds.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("x.metric", "x.v")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def topk_overlap(a: DataFrame, b: DataFrame, k: int, key: str = "candidate", rank: str = "rank") -> DataFrame:
    """Members that two rankings share in their first k (at most the shorter length)."""
    size = a.agg(F.count("*").alias("_x")).crossJoin(b.agg(F.count("*").alias("_y"))).select(F.greatest(F.lit(1), F.least(F.lit(k), F.col("_x"), F.col("_y"))).alias("k_used"))
    top = lambda d: d.crossJoin(F.broadcast(size)).filter(F.col(rank) <= F.col("k_used")).select(key)
    shared = top(a).join(top(b), key, "left_semi").agg(F.count("*").alias("n_shared"))
    return shared.crossJoin(size).select("k_used", "n_shared", (F.col("n_shared") / F.col("k_used")).alias("overlap"), (F.col("n_shared") / (2 * F.col("k_used") - F.col("n_shared"))).alias("jaccard"))


def compare_rankings(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """One row of agreement between two rankings: Spearman of ranks and scores, Kendall, overlap at every k."""
    m = a.select("candidate", F.col("score").cast("double").alias("x"), F.col("rank").cast("double").alias("rx")).join(b.select("candidate", F.col("score").cast("double").alias("y"), F.col("rank").cast("double").alias("ry")), "candidate")
    out = spearman(m, "rx", "ry", out="spearman_rank").join(spearman(m, "x", "y", out="spearman_score").drop("n")).join(kendall(m, "candidate", "rx", "ry"))
    for k in ks:
        out = out.join(topk_overlap(a, b, k).select(F.col("overlap").alias(f"overlap_{k}")))
    return out


def improvement(base: DataFrame, new: DataFrame) -> DataFrame:
    """Metric tables (metric, value) side by side, with delta and relative delta."""
    j = base.select("metric", F.col("value").alias("base")).join(new.select("metric", F.col("value").alias("new")), "metric", "full")
    return j.withColumn("delta", F.col("new") - F.col("base")).withColumn("relative_delta", ratio(F.col("new") - F.col("base"), F.abs("base")))


def interpret(metrics: DataFrame, lower_is_better: list[str], eps: float = 1e-9) -> DataFrame:
    """Each delta as improved, regressed, unchanged or not available."""
    signed = F.when(F.col("metric").isin(lower_is_better), -F.col("delta")).otherwise(F.col("delta"))
    return metrics.withColumn("verdict", F.when(signed.isNull(), "not_available").when(signed > eps, "improved").when(signed < -eps, "regressed").otherwise("unchanged"))


def derive_labels(items: DataFrame, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Candidate labels from item labels: mean at the threshold; if all alike, above the median; if still alike, upper half of mean ranks."""
    return labels_of_means(items.groupBy("candidate").agg(F.avg(label).alias("mean_label"), F.max(label).alias("max_label")), threshold)


def labels_of_means(m: DataFrame, threshold: float = 0.5) -> DataFrame:
    """:func:`derive_labels` of a table of candidates with ``mean_label`` and ``max_label``."""
    m = m.withColumn("_med", F.lit(exact_quantiles(m, ["mean_label"], [0.5])["mean_label"][0]))
    m = avg_rank(m, "mean_label", "_r")
    m = m.withColumn("_a", (F.col("mean_label") >= threshold).cast("int")).withColumn("_b", (F.col("mean_label") > F.col("_med")).cast("int")).withColumn("_c", (F.col("_r_pct") >= 0.5).cast("int"))
    pick = m.agg(F.countDistinct("_a").alias("_na"), F.countDistinct("_b").alias("_nb"))
    m = m.crossJoin(F.broadcast(pick))
    out = F.when(F.col("_na") > 1, F.col("_a")).when(F.col("_nb") > 1, F.col("_b")).otherwise(F.col("_c"))
    rule = F.when(F.col("_na") > 1, "mean_threshold").when(F.col("_nb") > 1, "above_median").otherwise("upper_half")
    return m.select("candidate", "mean_label", "max_label", out.alias("label"), rule.alias("rule"))


def label_coverage(df: DataFrame, label: str, least: int = 8) -> DataFrame:
    """How many labels there are and what they are good for."""
    a = df.agg(F.count(label).alias("n_valid"), F.countDistinct(label).alias("n_classes"))
    s = F.when(F.col("n_valid") == 0, "no_valid").when(F.col("n_classes") < 2, "degenerate").when(F.col("n_valid") < least, "compare_only").otherwise("usable_for_calibration")
    return a.withColumn("status", s)


def group_folds(df: DataFrame, n: int, seed: int = 7, group: str = "candidate", label: str = "label") -> DataFrame:
    """Folds of groups, dealt 0..n-1, n-1..0 by label mean, rows and a seeded hash."""
    g = df.groupBy(group).agg(F.avg(label).alias("_m"), F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("_m"), F.desc("_n"), F.md5(F.concat_ws(":", group, F.lit(seed))))
    g = g.withColumn("_p", F.row_number().over(w) - 1).withColumn("_i", F.col("_p") % (2 * n))
    return g.select(group, F.when(F.col("_i") < n, F.col("_i")).otherwise(2 * n - 1 - F.col("_i")).cast("int").alias("fold"))


def group_split(df: DataFrame, share: float, seed: int = 7, group: str = "candidate") -> DataFrame:
    """Groups for training or validation: the first by hash validate, one at least and not all."""
    g = df.select(group).distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    p = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.md5(F.concat_ws(":", group, F.lit(seed))), group))
    g = g.withColumn("_n", n).withColumn("_p", p)
    k = F.least(F.greatest(F.lit(1), F.round(F.col("_n") * share)), F.col("_n") - 1)
    return g.select(group, F.when(F.col("_p") <= k, "validation").otherwise("train").alias("side"))


def zscore_fit(df: DataFrame, cols: list[str], sample: bool = False) -> DataFrame:
    """One row of means and deviations; a deviation of nearly zero counts as 1."""
    std = F.stddev_samp if sample else F.stddev_pop
    return df.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.when(F.coalesce(std(c), F.lit(0.0)) < 1e-12, 1.0).otherwise(std(c)).alias(f"d_{c}") for c in cols))


def zscore_transform(df: DataFrame, fitted: DataFrame, cols: list[str], limit: float | None = None) -> DataFrame:
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in cols}
    if limit is not None:
        z = {c: F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x))) for c, x in z.items()}
    return df.crossJoin(F.broadcast(fitted)).select(*df.columns, *(x.alias(f"z_{c}") for c, x in z.items()))


def zscore_inverse(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    return df.crossJoin(F.broadcast(fitted)).select(*df.columns, *((F.col(f"z_{c}") * F.col(f"d_{c}") + F.col(f"m_{c}")).alias(f"x_{c}") for c in cols))
