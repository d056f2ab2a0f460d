"""Profiles, quality gate, consistency flags, audits and lineage of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import flags, ratio


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for each numeric column: missing share, moments, quantiles and share of the most common value."""
    n_rows = F.count("*")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select("x.column_name", "x.v")
    # Counts of values come first, combined before the shuffle; the moments follow from them.
    counts = long.groupBy("column_name", "v").agg(F.count("*").alias("k"))
    top = counts.filter("v IS NOT NULL").groupBy("column_name").agg(F.max("k").alias("_top"))
    g = long.groupBy("column_name").agg(
        n_rows.alias("n_rows"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"),
    ).join(top, "column_name", "left")
    g = g.withColumn("missing_ratio", 1 - F.col("n") / F.col("n_rows")).withColumn("top_ratio", ratio("_top", "n"))
    g = g.withColumn("p05", F.col("_q")[0]).withColumn("p50", F.col("_q")[1]).withColumn("p95", F.col("_q")[2]).withColumn("all_empty", F.col("n") == 0).withColumn("near_constant", F.coalesce(F.col("top_ratio") >= 0.995, F.lit(False)))
    return g.drop("_q", "_top")


def select_features(profiled: DataFrame, least: float = 0.05, most_missing: float = 0.80, modal: float = 0.995) -> DataFrame:
    """Columns that a model may use: enough values, not nearly constant, some spread."""
    ok = (1 - F.col("missing_ratio") >= least) & (F.col("missing_ratio") <= most_missing) & (F.coalesce(F.col("top_ratio"), F.lit(1.0)) < modal) & (F.coalesce(F.col("std"), F.lit(0.0)) > 1e-12)
    return profiled.select("column_name", ok.alias("selected"))


def processing_summary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows by status, and rows with a warning."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.count_if("has_warning").alias("n_warning"))


def quality_gate(df: DataFrame, feature: str, overwide: str, label: str, max_failed: float = 0.2, max_wide: float = 0.3) -> DataFrame:
    """Six checks of a feature table as rows: name, status, value, threshold. Any warning row makes its check WARN."""
    n = F.count("*")
    a = df.agg(n.alias("rows"), ratio(F.count_if(F.col("status") != "ok"), n, 0.0).alias("failed"), ratio(F.count_if("has_warning"), n, 0.0).alias("warned"), ratio(F.count_if(F.col(feature).isNull()), n, 1.0).alias("empty"), ratio(F.count_if(F.col(overwide) >= 0.55), n, 0.0).alias("wide"), F.countDistinct(label).alias("classes"))
    row = lambda name, value, status, limit: F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))
    c = F.col
    checks = F.array(
        row("row_count", c("rows"), F.when(c("rows") > 0, "PASS").otherwise("FAIL"), 1),
        row("failed_rows", c("failed"), F.when(c("failed") == 0, "PASS").when(c("failed") <= max_failed, "WARN").otherwise("FAIL"), max_failed),
        row("warning_rows", c("warned"), F.when(c("warned") == 0, "PASS").otherwise("WARN"), 0),
        row("empty_columns", c("empty"), F.when(c("empty") < 1, "PASS").otherwise("WARN"), 1),
        row("overwide", c("wide"), F.when(c("wide") <= max_wide, "PASS").otherwise("WARN"), max_wide),
        row("labels", c("classes"), F.when(c("classes") >= 2, "PASS").otherwise("WARN"), 2),
    )
    return a.select(F.explode(checks).alias("x")).select("x.*")


def worst_status(checks: DataFrame, by: list[str] = ()) -> DataFrame:
    """The worst of PASS, WARN and FAIL."""
    return checks.groupBy(*by).agg(F.max_by("status", F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)).alias("status"))


def proxy_flags(df: DataFrame, high: float = 0.6, low: float = 0.25, open_clearance: float = 4.0, disagreement: float = 0.55, wide: float = 0.55, low_overlap: float = 0.20) -> DataFrame:
    """Consistency flags of geometry proxies for each row, and a recommended action; columns that are absent count as NULL."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("double")
    hi, lo = (lambda x: F.coalesce(x >= high, F.lit(False))), (lambda x: F.coalesce(x <= low, F.lit(False)))
    some = lambda *x: F.coalesce(F.greatest(*x) >= high, F.lit(False))
    site, anchor = c("site_hit_fraction"), c("anchor_hit_fraction")
    mouth = some(c("mouth_occlusion"), c("mouth_axis_block"), c("mouth_aperture_block"))
    path = some(c("path_score"), c("path_fraction"), c("path_bottleneck"), c("path_exit_fraction"))
    path_clear, mouth_clear = F.coalesce(c("path_clearance") >= open_clearance, F.lit(False)), F.coalesce(c("mouth_clearance") >= open_clearance, F.lit(False))
    opened = lo(c("path_exit_fraction")) | lo(c("path_score")) | path_clear
    core = [site, anchor, c("mouth_occlusion"), c("path_score"), c("overlap_score")]
    known = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in core), F.lit(0))
    spread = F.greatest(*core) - F.least(*core)
    f = flags(
        ("site_overwide", F.coalesce(c("overwide") >= wide, F.lit(False))), ("shell_overwide", F.coalesce(c("shell_overwide") >= wide, F.lit(False))), ("shell_high_core_low", hi(c("shell_hit_fraction")) & lo(anchor)),
        ("low_shell_overlap", F.coalesce(c("shell_overlap") <= low_overlap, F.lit(False))), ("mouth_high_path_open", mouth & opened), ("path_high_site_low", path & lo(site)), ("path_high_anchor_low", path & lo(anchor)),
        ("contact_high_block_low", hi(site) & hi(anchor) & ~mouth & ~path), ("mouth_high_clearance_open", mouth & mouth_clear), ("path_high_clearance_open", path & path_clear), ("core_disagreement", (known >= 3) & (spread >= disagreement)),
    )
    d = df.withColumn("proxy_flags", f)
    has = lambda *n: F.arrays_overlap("proxy_flags", F.array(*map(F.lit, n)))
    action = F.when(F.size("proxy_flags") == 0, "none").when(has("site_overwide", "shell_overwide"), "tighten_site").when(has("low_shell_overlap", "shell_high_core_low"), "check_anchor").when(has("mouth_high_path_open", "mouth_high_clearance_open", "path_high_clearance_open"), "check_path").otherwise("inspect_item")
    return d.withColumn("action", action)


def audit_by_candidate(flagged: DataFrame, n_flags: int = 4) -> DataFrame:
    """Flagged rows and share of each candidate, and its most common flags."""
    base = flagged.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.size("proxy_flags") > 0).alias("n_flagged"))
    k = flagged.select("candidate", F.explode("proxy_flags").alias("flag")).groupBy("candidate", "flag").count()
    w = Window.partitionBy("candidate").orderBy(F.desc("count"), "flag")
    top = k.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_flags).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "flag"))), lambda x: x["flag"]).alias("top_flags"))
    return base.join(top, "candidate", "left").withColumn("top_flags", F.coalesce("top_flags", F.array().cast("array<string>"))).withColumn("flagged_fraction", F.col("n_flagged") / F.col("n"))


def risky_rows(df: DataFrame, n: int) -> DataFrame:
    """The n rows of the highest risk."""
    score = 10.0 * (F.col("status") != "ok").cast("int") + 3.0 * F.col("has_warning").cast("int") + F.coalesce(F.col("overwide"), F.lit(0.0))
    return df.withColumn("risk_score", score).orderBy(F.desc("risk_score"), "item").limit(n)


def lineage_groups(runs: DataFrame, hashes: list[str]) -> DataFrame:
    """Previous run with the same hash and size of its group, for every hash column; an empty hash has no group."""
    for h in hashes:
        w = Window.partitionBy(h)
        known = F.coalesce(F.col(h), F.lit("")) != ""
        grouped = runs.filter(known).withColumn(f"{h}_previous", F.lag("run").over(w.orderBy("started_at", "run"))).withColumn(f"{h}_size", F.count("*").over(w))
        runs = grouped.unionByName(runs.filter(~known), allowMissingColumns=True)
    return runs


def lineage_edges(runs: DataFrame, hashes: list[str]) -> DataFrame:
    """Edges from each run to the nodes of its hashes."""
    return runs.select("run", F.explode(F.array(*(F.struct(F.lit(h).alias("kind"), F.col(h).alias("node")) for h in hashes))).alias("x")).filter(F.coalesce(F.col("x.node"), F.lit("")) != "").select("run", "x.kind", "x.node")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (path, sha256, size) against actual files."""
    d = expected.join(actual.select("path", F.col("sha256").alias("_h"), F.col("size").alias("_s"), F.lit(True).alias("_here")), "path", "left")
    s = F.when(F.coalesce(F.col("sha256"), F.lit("")) == "", "invalid").when(F.col("_here").isNull(), "missing").when(F.col("_s") != F.col("size"), "size_mismatch").when(F.col("_h") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    return d.select("path", s.alias("status"))


def plan_path_repair(refs: DataFrame, files: DataFrame) -> DataFrame:
    """The best file for every missing reference: by name and as many parts before it as possible, else by stem.

    ``refs`` (ref) and ``files`` (path).  Returns ref, path, confidence, reason,
    candidates (files of the name, or of the stem) and auto (0.70 or more); references
    that nothing matches are left out.  Case does not count; ties go to the first path.

    Every file is listed under all of its trailing parts, with the number of files and
    the first of them there, so a reference meets one row for each of its own trailing
    parts, however common its name is.
    """
    parts = lambda c: F.split(F.lower(F.regexp_replace(c, r"\\", "/")), "/")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts(c), -n, n), "/").alias("tail")))
    stem = lambda c: F.struct(F.lit(0).alias("depth"), F.regexp_replace(F.element_at(parts(c), -1), r"(?<=.)\.[^.]*$", "").alias("tail"))
    listed = lambda c: F.explode(F.concat(F.array(stem(c)), tails(c)))
    lost = refs.select("ref").distinct().join(files.select(F.col("path").alias("ref")), "ref", "left_anti")
    index = files.select("path", listed("path").alias("k")).groupBy("k.depth", "k.tail").agg(F.count("*").alias("n"), F.min_by("path", F.struct(F.lower("path"), "path")).alias("path"))
    met = lost.select("ref", listed("ref").alias("k")).select("ref", "k.*").join(index, ["depth", "tail"])
    g = met.groupBy("ref").agg(F.max_by(F.struct("depth", "n", "path"), "depth").alias("best"), F.max(F.when(F.col("depth") == 1, F.col("n"))).alias("names"))
    depth, n, names = F.col("best.depth"), F.col("best.n"), F.col("names")
    rules = [
        (names == 1, 0.96, "unique_name"), (names.isNotNull() & (depth >= 2) & (n == 1), 0.90, "name_and_context"), (names.isNotNull() & (n == 1), 0.78, "name_best_context"), (names.isNotNull(), 0.58, "several_names"),
        (n == 1, 0.72, "unique_stem"),
    ]
    found = F.coalesce(*(F.when(cond, F.struct(F.lit(c).alias("c"), F.lit(why).alias("why"))) for cond, c, why in rules), F.struct(F.lit(0.45).alias("c"), F.lit("several_stems").alias("why")))
    return g.select("ref", F.col("best.path").alias("path"), found.alias("f"), F.coalesce(names, n).alias("candidates")).select("ref", "path", F.col("f.c").alias("confidence"), F.col("f.why").alias("reason"), "candidates", (F.col("f.c") >= 0.70).alias("auto"))


def apply_path_repair(df: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """References replaced where the plan is sure enough."""
    p = plan.filter("auto").select(F.col("ref").alias(column), F.col("path").alias("_new"))
    return df.join(p, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def representative_item(items: DataFrame, energy: str) -> DataFrame:
    """The item of least energy of each candidate, or the first by id if it has none."""
    return items.groupBy("candidate").agg(F.coalesce(F.min_by("item", F.when(F.col(energy).isNotNull(), F.struct(energy, "item"))), F.min("item")).alias("item"))


#: Types that count as numbers in a summary: true and false do not.
NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def read_summaries(spark, path: str) -> DataFrame:
    """``file, v`` of JSON files of one object each, as VARIANT; NULL where a file is not JSON. Nothing is inferred from the data."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return d.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))


def number_at(v: Column | str, path: str) -> Column:
    """The number at a path of a VARIANT; NULL where there is none, or something that is not a number."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part).rlike(NUMBERS), F.try_variant_get(v, path, "double"))


def text_at(v: Column | str, path: str) -> Column:
    """The text or number at a path of a VARIANT as text."""
    part = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when((part == "STRING") | part.rlike(NUMBERS), F.try_variant_get(v, path, "string"))


def result_panel(spark, path: str, numbers: dict[str, str], texts: dict[str, str] | None = None) -> DataFrame:
    """``file, status`` and one column for each name, from the path given for it, of per-result JSON summaries.

    A path that is nowhere gives NULLs, and so does a value of another type; ``status``
    is unreadable for files that are not JSON.
    """
    d = read_summaries(spark, path)
    status = F.when(F.col("v").isNull(), "unreadable").otherwise("ok")
    return d.select("file", status.alias("status"), *(number_at("v", at).alias(n) for n, at in numbers.items()), *(text_at("v", at).alias(n) for n, at in (texts or {}).items()))


def summary_values(spark, path: str, section: str = "metrics") -> DataFrame:
    """``file, metric, value``: every number of a section of the summaries, whatever their names."""
    d = read_summaries(spark, path).select("file", F.try_variant_get("v", f"$.{section}", "variant").alias("_s"))
    pairs = d.lateralJoin(spark.tvf.variant_explode(F.col("_s").outer()))
    return pairs.select("file", F.col("key").alias("metric"), number_at("value", "$").alias("value")).filter("metric IS NOT NULL AND value IS NOT NULL")


def run_archive(runs: DataFrame, metrics: list[str], artefacts: DataFrame, expected: list[str], order: str = "started_at") -> DataFrame:
    """One row for each run and metric that it has: value, that of the run before, their difference and trend, and which artefacts are there.

    ``runs`` has run, the order and the metrics; ``artefacts`` run and artefact.
    """
    long = runs.select("run", order, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("run", order, "x.metric", "x.value").filter("value IS NOT NULL")
    w = Window.partitionBy("metric").orderBy(order, "run")
    d = long.withColumn("previous", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("previous"))
    d = d.withColumn("trend", F.when(F.col("delta").isNull(), "first").when(F.col("delta") > 1e-9, "up").when(F.col("delta") < -1e-9, "down").otherwise("same"))
    here = artefacts.groupBy("run").agg(*(F.bool_or(F.col("artefact") == a).alias(f"has_{a}") for a in expected))
    d = d.join(here, "run", "left").drop(order)
    return d.select(*(c for c in d.columns if c[4:] not in expected), *(F.coalesce(f"has_{a}", F.lit(False)).alias(f"has_{a}") for a in expected))
