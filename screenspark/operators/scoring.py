"""Rule score, top-k selection and the roll-up of items to variants and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, severity, steady, weighted_available_mean
from screenspark.operators.quantiles import exact_quantiles
from screenspark.plans.staging import staged

KEYS = ("candidate", "variant", "item")
#: Sign (+1 larger is better, -1 smaller is better) and weight of each rule feature.
RULE_FEATURES = {
    "site_hit_fraction": (1, 0.20), "anchor_hit_fraction": (1, 0.14), "mouth_occlusion": (1, 0.14), "mouth_axis_block": (1, 0.06),
    "mouth_aperture_block": (1, 0.06), "mouth_clearance": (-1, 0.03), "occupancy_delta": (1, 0.12), "overlap_score": (1, 0.10),
    "path_score": (1, 0.06), "path_fraction": (1, 0.05), "path_bottleneck": (1, 0.04), "path_exit_fraction": (1, 0.04),
    "path_clearance": (-1, 0.03), "site_distance": (-1, 0.08), "site_accuracy": (1, 0.06), "energy_pb_a": (-1, 0.05),
    "energy_pb_b": (-1, 0.05), "energy_gb": (-1, 0.05), "interface_energy": (-1, 0.03),
}
#: Weights of the geometry part of a variant's score.
GEOMETRY_WEIGHTS = {"site_hit_fraction": 0.34, "anchor_hit_fraction": 0.25, "mouth_occlusion": 0.16, "mouth_aperture_block": 0.13, "overlap_score": 0.07, "path_exit_fraction": 0.05}
#: Weights of the consistency of variants.
CONSISTENCY_WEIGHTS = {"site_hit_fraction": 0.34, "anchor_hit_fraction": 0.26, "mouth_occlusion": 0.16, "mouth_aperture_block": 0.14, "overlap_score": 0.05, "path_exit_fraction": 0.05}
#: Energy columns by preference, for the top-k selection.
ENERGY_COLUMNS = ("energy_pb_a", "energy_pb_b", "energy_gb")


def detect_numeric_columns(df: DataFrame, hints: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns with a finite value or on the hint list; ids, paths and ``exclude`` are left out. One aggregate."""
    names = [c for c in df.columns if not c.endswith(("_id", "_path")) and c not in exclude]
    if not names:
        return []
    d = {c: F.col(c).try_cast("double") for c in names if df.schema[c].dataType.simpleString() not in ("array", "map")}
    row = df.agg(*(F.count(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), 1)).alias(c) for c, v in d.items())).first()
    return [c for c in names if c in hints or (c in d and row[c] > 0)]


def keep_ok(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows with status ok if there is any such row, else all rows; staged first, so that no join behind them runs for the question and again for the rows."""
    df = staged(df, "items")
    ok = df.filter(F.col(status) == "ok")
    ok.staged = True
    return df if ok.isEmpty() else ok


def robust_bounds(df: DataFrame, cols: list[str], lq: float = 0.01, uq: float = 0.99, approx: int | None = None) -> dict[str, tuple[float | None, float | None]]:
    """The lower and upper quantile of every column, as scalars.

    ``approx`` switches to approximate quantiles of that accuracy.
    """
    if approx is None:
        return {c: tuple(q) for c, q in exact_quantiles(df, cols, [lq, uq]).items()}
    row = df.agg(*(F.percentile_approx(c, [lq, uq], approx).alias(str(i)) for i, c in enumerate(cols))).first()
    return {c: tuple(q) if q else (None, None) for c, q in zip(cols, row, strict=True)}


def scaled(c: str, lo: float | None, hi: float | None) -> Column:
    """Robust min-max of a column; a constant column is 0.5, NULL stays NULL."""
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if hi - lo < 1e-12:
        return F.when(F.col(c).isNotNull(), 0.5)
    return clip((F.col(c) - lo) / (hi - lo), 0, 1)


def robust_scale(df: DataFrame, cols: list[str], lq: float = 0.01, uq: float = 0.99, approx: int | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with ``s_<col>`` for every column; the bounds, of ``fit_on`` if given, are scalars in the plan, so nothing is joined."""
    bounds = robust_bounds(df if fit_on is None else fit_on, cols, lq, uq, approx) if cols else {}
    return df.select(*(c for c in df.columns if c[2:] not in cols or not c.startswith("s_")), *(scaled(c, *bounds[c]).alias(f"s_{c}") for c in cols))


def rule_score(items: DataFrame, features: dict[str, tuple[int, float]] = RULE_FEATURES, out: str = "rule_score", fit_on: DataFrame | None = None) -> DataFrame:
    """Sign-aligned, robust-scaled, weighted mean over the features that a row has.

    Rows without any feature get the median of the scores (0.5 if there is none).
    The rows are staged once, as bounds, median and scores are passes over them.  The
    bounds are those of the rows, or of ``fit_on``.
    """
    items = staged(items, "items")
    cols = [c for c in features if c in items.columns]
    df = robust_scale(items, cols, fit_on=fit_on)
    df = df.withColumn("_raw", rule_mean(features, cols))
    median = 0.5
    if not df.filter(F.col("_raw").isNull()).isEmpty():
        (found,) = exact_quantiles(df, ["_raw"], [0.5])["_raw"]
        median = 0.5 if found is None else found
    return df.withColumn(out, clip(F.coalesce("_raw", F.lit(median)), 0, 1)).drop("_raw")


def rule_mean(features: dict[str, tuple[int, float]], cols: list[str], prefix: str = "s_") -> Column:
    """Sign-aligned, weighted mean of the scaled columns ``<prefix><col>`` that a row has."""
    aligned = [(F.col(prefix + c) if features[c][0] > 0 else 1 - F.col(prefix + c), features[c][1]) for c in cols]
    return weighted_available_mean(aligned) if aligned else F.lit(None).cast("double")


def top_components(parts: dict[str, Column], k: int = 3) -> Column:
    """The k largest contributions of a row by size, as ``name=value`` with three digits."""
    rows = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct((-F.abs(v)).alias("o"), F.lit(n).alias("n"), v.alias("v"))) for n, v in parts.items())))
    return F.array_join(F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.concat(x["n"], F.lit("="), F.format_string("%.3f", x["v"]))), ";")


def select_topk(df: DataFrame, k: int = 3, score: str = "rule_score", selection: str = "auto", keys: tuple[str, str] = ("candidate", "variant"), item: str = "item", energies: tuple[str, ...] = ENERGY_COLUMNS) -> DataFrame:
    """The k selected items of each group, with ``topk_position, selection_mode, selection_column``.

    ``auto``: by the first energy column that has a value in the group, ascending,
    missing energy last; a group without energies goes by score.  ``score``: by
    score.  Any other column: that column, ascending.  Ties go by score at nine digits, then item.
    """
    cols = [c for c in energies if c in df.columns] if selection == "auto" else [] if selection == "score" else [selection]
    parts = []
    for i, c in enumerate(cols or [None]):  # the first k of each order, which is cut down before the shuffle
        value = F.col(c).asc_nulls_last() if c else F.lit(None).asc_nulls_last()
        order = Window.partitionBy(*keys).orderBy(value, steady(score).desc_nulls_last(), item)
        part = df.withColumn("topk_position", F.row_number().over(order)).filter(F.col("topk_position") <= k)
        parts.append(part.withColumn("_order", F.lit(i)).withColumn("_has", F.col(c).isNotNull() if c else F.lit(False)))
    top = parts[0]
    for part in parts[1:]:
        top = top.unionByName(part)
    # The first order whose best row has a value; without any, all orders are that of the score.
    best = F.min(F.when((F.col("topk_position") == 1) & F.col("_has"), F.col("_order"))).over(Window.partitionBy(*keys))
    top = top.withColumn("_best", best).filter(F.col("_order") == F.coalesce("_best", F.lit(0)))
    if selection == "auto":
        names = F.coalesce(*(F.when(F.col("_best") == i, F.lit(c)) for i, c in enumerate(cols)), F.lit(score)) if cols else F.lit(score)
        top = top.withColumn("selection_column", names).withColumn("selection_mode", F.when(F.col("_best").isNull(), "score_desc").otherwise("energy_asc"))
    else:
        top = top.withColumn("selection_column", F.lit(score if selection == "score" else selection)).withColumn("selection_mode", F.lit("score_desc" if selection == "score" else "custom_asc"))
    return top.drop("_order", "_has", "_best")


def rollup_variants(df: DataFrame, k: int = 3, score: str = "rule_score", selection: str = "auto", geo_weight: float = 0.15, penalty_weight: float = 0.0, overwide: str | None = "overwide", threshold: float = 0.55, is_scaled: bool = False) -> DataFrame:
    """One row for each variant: means over its top items, its best item and its score; ``is_scaled``: the rows have ``s_<col>`` of the geometry columns already."""
    geo = [c for c in GEOMETRY_WEIGHTS if c in df.columns]
    df = df.filter(F.col(score).isNotNull())
    df = df if is_scaled else robust_scale(df, geo)
    sizes = df.groupBy("candidate", "variant").agg(F.count("*").alias("n_items"))
    top = select_topk(df, k, score, selection)
    wide = overwide if overwide in df.columns else None
    means = [c for c in dict.fromkeys([*CONSISTENCY_WEIGHTS, *([wide] if wide else [])]) if c in df.columns]
    rolled = top.groupBy("candidate", "variant").agg(
        F.count("*").alias("top_k_used"), F.first("selection_mode").alias("selection_mode"), F.first("selection_column").alias("selection_column"),
        F.transform(F.array_sort(F.collect_list(F.struct("topk_position", "item"))), lambda x: x["item"]).alias("topk_items"),
        F.min_by("item", "topk_position").alias("best_item"), F.min_by(score, "topk_position").alias("best_score"), F.avg(score).alias("mean_score"),
        *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.avg(f"s_{c}").alias(f"_aux_{c}") for c in geo),
    )
    aux = weighted_available_mean([(F.col(f"_aux_{c}"), GEOMETRY_WEIGHTS[c]) for c in geo]) if geo else F.lit(None).cast("double")
    weight = F.when(F.col("geometry_score").isNull(), 0.0).otherwise(min(max(geo_weight, 0.0), 0.40))
    base = 0.7 * F.col("mean_score") + 0.3 * F.col("best_score")
    penalty = F.lit(penalty_weight) * severity(f"mean_{wide}", threshold) if wide else F.lit(0.0)
    rolled = rolled.withColumn("geometry_score", aux).withColumn("variant_score", clip((1 - weight) * base + weight * F.coalesce("geometry_score", F.lit(0.0)) - penalty, 0, 1))
    return rolled.drop(*(f"_aux_{c}" for c in geo)).join(sizes, ["candidate", "variant"])


def consistency_parts(columns: list[str] | None = None) -> Column:
    """Weighted hit of a variant over the columns that it has, each clipped to 0..1 first."""
    names = columns if columns is not None else list(CONSISTENCY_WEIGHTS)
    return weighted_available_mean([(clip(f"mean_{c}", 0, 1), CONSISTENCY_WEIGHTS[c]) for c in names])


def rollup_candidates(variants: DataFrame, weights: tuple[float, float, float, float] = (0.50, 0.25, 0.20, 0.15), hit_threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: mean, best, population deviation, consistency and final score of its variants."""
    w1, w2, w3, w4 = (max(0.0, w) for w in weights)
    names = [c for c in CONSISTENCY_WEIGHTS if f"mean_{c}" in variants.columns]
    df = variants.withColumn("_hit", consistency_parts(names))
    out = df.groupBy("candidate").agg(
        F.count("*").alias("n_variants"), F.sum("n_items").alias("n_items"), F.avg("variant_score").alias("mean_variant_score"), F.max("variant_score").alias("best_variant_score"),
        F.max_by("variant", F.struct(steady("variant_score"), "variant")).alias("best_variant"), F.stddev_pop("variant_score").alias("std_variant_score"),
        F.avg("_hit").alias("_mean"), F.avg(F.when(F.col("_hit").isNotNull(), F.when(steady("_hit") >= hit_threshold, 1.0).otherwise(0.0))).alias("_share"), F.stddev_pop("_hit").alias("_std"),
        *(F.avg(f"mean_{c}").alias(f"mean_{c}") for c in [*names, *(["overwide"] if "mean_overwide" in variants.columns else [])]),
    )
    out = out.withColumn("consistency", clip(0.60 * F.col("_mean") + 0.30 * F.col("_share") + 0.10 * (1 - clip("_std", 0, 1)), 0, 1)).drop("_mean", "_share", "_std")
    final = w1 * F.col("mean_variant_score") + w2 * F.col("best_variant_score") + w3 * F.coalesce("consistency", F.lit(0.0)) - w4 * F.col("std_variant_score")
    return out.withColumn("final_score", final)


def assign_rank(df: DataFrame, order: list[Column], out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rank 1..n in the given order; only for tables of candidate size unless ``by`` is given."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w))


def final_order() -> list[Column]:
    """The order of candidates: final score and best variant's score at nine digits, then candidate."""
    return [F.desc_nulls_last(steady("final_score")), F.desc_nulls_last(steady("best_variant_score")), F.asc("candidate")]


def rank_candidates(items: DataFrame, k: int = 3) -> DataFrame:
    """Items to ranked candidates: rule score, top-k, variants, candidates, rank."""
    ranked = rollup_candidates(rollup_variants(rule_score(keep_ok(items)), k))
    return assign_rank(ranked, final_order())
