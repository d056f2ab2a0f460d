"""Key sets: method consensus, accuracy against a truth, evidence support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clip, flags, ratio


def method_consensus(sets: DataFrame, methods: list[str], min_count: int = 2, min_fraction: float = 0.0) -> DataFrame:
    """Support of every (structure, key) over methods, consensus and method-specific flags, one column for each method."""
    total = sets.groupBy("structure").agg(F.countDistinct("method").alias("n_methods"))
    g = sets.groupBy("structure", "key").agg(F.countDistinct("method").alias("support"), *(F.coalesce(F.bool_or(F.col("method") == m), F.lit(False)).alias(f"in_{m}") for m in methods))
    g = g.join(total, "structure")
    need = F.least(F.col("n_methods"), F.greatest(F.lit(min_count), F.ceil(F.lit(min_fraction) * F.col("n_methods"))))
    return g.withColumn("fraction", F.col("support") / F.col("n_methods")).withColumn("consensus", F.col("support") >= need).withColumn("specific", F.col("support") == 1)


def set_accuracy(predicted: DataFrame, truth: DataFrame, by: list[str] = ("structure",), key: str = "key") -> DataFrame:
    """Coverage, precision, Jaccard, F1 and utility of predicted keys against the truth, by group.

    ``truth`` has the structure; precision 0 / 0 is NULL.
    """
    by = list(by)
    extra = [c for c in by if c != "structure"]
    t = truth.select("structure", key).distinct()
    groups = predicted.select(*by).distinct()
    wanted = groups.join(t, "structure").withColumn("_t", F.lit(1))
    both = predicted.select(*by, key).distinct().withColumn("_p", F.lit(1)).join(wanted, [*by, key], "full")
    g = both.groupBy(*by).agg(F.count("_p").alias("n_predicted"), F.count("_t").alias("n_truth"), F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("n_hit"))
    g = g.withColumn("coverage", ratio("n_hit", "n_truth")).withColumn("precision", ratio("n_hit", "n_predicted")).withColumn("jaccard", ratio("n_hit", F.col("n_predicted") + F.col("n_truth") - F.col("n_hit")))
    return g.withColumn("f1", ratio(2 * F.col("n_hit"), F.col("n_predicted") + F.col("n_truth"))).withColumn("utility", 0.6 * F.col("coverage") + 0.4 * F.coalesce("precision", F.lit(0.0))).select(*by, *(c for c in g.columns if c not in by and c not in extra), "f1", "utility")


def set_differences(predicted: DataFrame, truth: DataFrame, key: str = "key") -> DataFrame:
    """Keys of the truth that are missing and predicted keys that are extra, as anti joins."""
    missing = truth.join(predicted, ["structure", key], "left_anti").select("structure", key, F.lit("missing").alias("kind"))
    return missing.unionByName(predicted.join(truth, ["structure", key], "left_anti").select("structure", key, F.lit("extra").alias("kind"))).distinct()


def pairwise_jaccard(sets: DataFrame) -> DataFrame:
    """Shared keys, Jaccard and overlap shares of every pair of methods of a structure; pairs that share nothing stay."""
    d = sets.select("structure", "method", "key").distinct()
    size = d.groupBy("structure", "method").agg(F.count("*").alias("n"))
    a, b = size.alias("a"), size.alias("b")
    names = a.join(b, (F.col("a.structure") == F.col("b.structure")) & (F.col("a.method") < F.col("b.method"))).select("a.structure", F.col("a.method").alias("left"), F.col("b.method").alias("right"), F.col("a.n").alias("n_left"), F.col("b.n").alias("n_right"))
    x, y = d.alias("x"), d.alias("y")
    shared = x.join(y, (F.col("x.structure") == F.col("y.structure")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.method") < F.col("y.method"))).groupBy("x.structure", F.col("x.method").alias("left"), F.col("y.method").alias("right")).agg(F.count("*").alias("n_shared"))
    out = names.join(shared, ["structure", "left", "right"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return out.withColumn("jaccard", ratio("n_shared", F.col("n_left") + F.col("n_right") - F.col("n_shared"))).withColumn("left_overlap", ratio("n_shared", "n_left")).withColumn("right_overlap", ratio("n_shared", "n_right"))


def method_summary(sets: DataFrame, truth: DataFrame, min_count: int = 2) -> DataFrame:
    """Each method of a structure against the consensus, the truth and the usual size; truth-free over-wide risk."""
    d = sets.select("structure", "method", "key").distinct()
    support = d.groupBy("structure", "key").agg(F.count("*").alias("_k"))
    marked = d.join(support, ["structure", "key"]).join(truth.select("structure", "key").distinct().withColumn("_t", F.lit(1)), ["structure", "key"], "left")
    g = marked.groupBy("structure", "method").agg(F.count("*").alias("n"), F.count_if(F.col("_k") >= min_count).alias("n_consensus"), F.count_if(F.col("_k") == 1).alias("n_specific"), F.count("_t").alias("n_truth_hit"))
    median = g.groupBy("structure").agg(F.median("n").alias("_m"))
    n_truth = truth.select("structure", "key").distinct().groupBy("structure").agg(F.count("*").alias("_nt"))
    g = g.join(median, "structure").join(n_truth, "structure", "left")
    g = g.withColumn("size_ratio", F.col("n") / F.col("_m")).withColumn("coverage", ratio("n_truth_hit", "_nt")).withColumn("precision", ratio("n_truth_hit", "n"))
    risk = clip(0.7 * clip((F.col("size_ratio") - 1) / 2, 0, 1) + 0.3 * ratio("n_specific", "n", 0.0), 0, 1)
    return g.withColumn("overwide_risk", risk).drop("_m", "_nt")


def sweep_support(sets: DataFrame, truth: DataFrame, counts: list[int]) -> DataFrame:
    """Accuracy of the keys that at least c methods give, for every c; support is counted once."""
    support = sets.select("structure", "method", "key").distinct().groupBy("structure", "key").agg(F.count("*").alias("_k"))
    grid = sets.sparkSession.createDataFrame([(int(c),) for c in counts], "min_count int")
    return set_accuracy(support.crossJoin(F.broadcast(grid)).filter("_k >= min_count").select("min_count", "structure", "key"), truth, ["min_count", "structure"])


def best_by_group(df: DataFrame, key: str) -> DataFrame:
    """The best row of each group by utility, coverage and precision."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(F.round("utility", 9)), F.desc_nulls_last(F.round("coverage", 9)), F.desc_nulls_last(F.round("precision", 9)), *(c for c in df.columns if c.startswith("min_")))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def penalty_sweep(df: DataFrame, weights: list[float], utility: str = "utility", risk: str = "overwide_risk") -> DataFrame:
    """Utility less a weighted risk, at every weight."""
    grid = df.sparkSession.createDataFrame([(float(w),) for w in weights], "weight double")
    return df.crossJoin(F.broadcast(grid)).withColumn("adjusted", clip(F.col(utility) - F.col("weight") * F.col(risk), 0, 1))


def aggregate_support(evidence: DataFrame, min_support: float = 1.0) -> DataFrame:
    """Evidence of every (structure, key): weighted sum, counts, best weight, nearest distance, methods and flags.

    ``evidence`` has structure, key, method, source, weight, distance, curated.
    """
    g = evidence.groupBy("structure", "key").agg(
        F.sum("weight").alias("support"), F.count("*").alias("n_evidence"), F.countDistinct("method").alias("n_methods"), F.count_if(F.col("weight") >= 0.75).alias("n_high"),
        F.max("weight").alias("max_weight"), F.min("distance").alias("min_distance"), F.array_sort(F.collect_set("method")).alias("methods"), F.coalesce(F.bool_or("curated"), F.lit(False)).alias("curated"),
    )
    review = flags(("single_method", F.col("n_methods") == 1), ("low_support", F.col("support") < min_support), ("not_curated", ~F.col("curated")))
    return g.withColumn("supported", F.col("curated") | (F.col("support") >= min_support)).withColumn("review", review)


def precision_guard(evidence: DataFrame, n_residues: DataFrame, max_n: int, max_fraction: float) -> DataFrame:
    """External tools that predict too many keys, and their keys without trusted evidence.

    ``evidence`` has structure, key, source, external; ``n_residues`` structure, n.
    """
    ext = evidence.filter("external")
    size = ext.groupBy("structure", "source").agg(F.countDistinct("key").alias("n_keys")).join(n_residues, "structure")
    wide = size.filter(F.col("n_keys") > F.greatest(F.lit(max_n), F.ceil(F.lit(max_fraction) * F.col("n")))).select("structure", "source")
    trusted = evidence.groupBy("structure", "key").agg(F.bool_or(~F.col("external")).alias("trusted"))
    return ext.join(wide, ["structure", "source"], "left_semi").select("structure", "key").distinct().join(trusted.filter("NOT trusted"), ["structure", "key"], "left_semi")


def source_audit(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues of every key's source record: none, no reference, no identifier, low quality."""
    d = keys.join(sources, "source", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return d.withColumn("issues", flags(("missing_source", F.col("reference").isNull() & F.col("identifier").isNull()), ("no_reference", blank("reference")), ("no_identifier", blank("identifier")), ("low_quality", F.coalesce(F.col("quality") < 0.5, F.lit(False)))))


def coverage(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected (id, method) against returned (id, method, path): ready, missing or unexpected, with the paths."""
    r = returned.groupBy("id", "method").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("path")).alias("paths"))
    j = expected.select("id", "method", F.lit(True).alias("_e")).distinct().join(r, ["id", "method"], "full")
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n_files").isNull(), "missing").otherwise("ready")
    return j.select("id", "method", status.alias("status"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def return_gate(cover: DataFrame) -> DataFrame:
    """Decision from coverage counts: FAIL without any file, WARN if some are missing or unexpected, else PASS."""
    c = cover.agg(F.count_if(F.col("status") == "ready").alias("n_ready"), F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if(F.col("status") == "unexpected").alias("n_unexpected"))
    d = F.when(F.col("n_ready") + F.col("n_missing") == 0, "FAIL_NOTHING_EXPECTED").when(F.col("n_ready") == 0, "FAIL_NOTHING_RETURNED").when(F.col("n_missing") > 0, "WARN_PARTIAL").when(F.col("n_unexpected") > 0, "WARN_UNEXPECTED")
    return c.withColumn("decision", d.otherwise("PASS"))


def action_plan(cover: DataFrame, preflight: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do next for every (id, method): from coverage, preflight of the id and its manifest row."""
    d = cover.join(preflight, "id", "left").join(manifest.select("id", "method", F.lit(True).alias("listed")), ["id", "method"], "left")
    act = F.when(F.col("status") == "unexpected", "review_unexpected").when(~F.coalesce(F.col("input_ok"), F.lit(False)), "fix_input").when(F.col("status") == "missing", "run_tool").when(F.col("listed").isNull(), "add_to_manifest").otherwise("run_benchmark")
    level = F.when(act == "fix_input", 1).when(act == "run_tool", 2).when(act == "add_to_manifest", 3).when(act == "review_unexpected", 4).otherwise(5)
    return d.select("id", "method", "status", act.alias("action"), level.alias("priority"))


def expansion_plan(targets: DataFrame, manifest: DataFrame, panel: DataFrame) -> DataFrame:
    """Status of every target (id, methods array) and method: complete, manifest_ready or needs_<method>."""
    want = targets.select("id", F.explode("methods").alias("method"))
    d = want.join(panel.select("id", "method", F.lit(True).alias("_done")).distinct(), ["id", "method"], "left").join(manifest.select("id", "method", F.lit(True).alias("_m")).distinct(), ["id", "method"], "left")
    return d.select("id", "method", F.when(F.col("_done"), "complete").when(F.col("_m"), "manifest_ready").otherwise(F.concat(F.lit("needs_"), "method")).alias("status"))


