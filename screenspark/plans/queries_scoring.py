"""Queries: cleaning, rule score, roll-ups and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clean_text, finite, first_nonempty, steady, time_or_min, token
from screenspark.operators import scoring
from screenspark.operators.selection import NOT_FEATURES
from screenspark.plans import views as v
from screenspark.plans.registry import register, select_sql
from screenspark.plans.tables import table

VARIANTS = [v.ITEMS, v.SCORED, v.variants_ctes()]
CANDIDATES = [*VARIANTS, v.candidates_ctes()]


@register("sc1_rule_score", v.with_sql(v.ITEMS, v.SCORED, select=select_sql("scored", "candidate, variant, item", "rule_score")))
def sc1_rule_score(spark, sf_dir):
    return scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir))).select("candidate", "variant", "item", "rule_score")


@register("sc1_rank_candidates", v.with_sql(*CANDIDATES, select=select_sql("candidates", "rank, candidate, n_variants, n_items, best_variant", "mean_variant_score, best_variant_score, std_variant_score, consistency, final_score")))
def sc1_rank_candidates(spark, sf_dir):
    return scoring.rank_candidates(v.items(spark, sf_dir)).select("rank", "candidate", "n_variants", "n_items", "best_variant", "mean_variant_score", "best_variant_score", "std_variant_score", "consistency", "final_score")


_LACKING = v.ITEMS.replace("l_extendedprice AS energy_gb", "CASE WHEN NOT (l_suppkey % 4 = 0 AND l_returnflag = 'N') THEN l_extendedprice END AS energy_gb")


@register("ag1_topk_selection", v.with_sql(_LACKING, v.SCORED, select="SELECT candidate, variant, item, CAST(topk_position AS INTEGER) AS topk_position, CASE WHEN has THEN 'energy_asc' ELSE 'score_desc' END AS selection_mode, CASE WHEN has THEN 'energy_gb' ELSE 'rule_score' END AS selection_column FROM (SELECT *, row_number() OVER (PARTITION BY candidate, variant ORDER BY energy_gb ASC NULLS LAST, round(rule_score, 9) DESC NULLS LAST, item) AS topk_position, max(energy_gb) OVER (PARTITION BY candidate, variant) IS NOT NULL AS has FROM scored) WHERE topk_position <= 3"))
def ag1_topk_selection(spark, sf_dir):
    """Some variants have no energies and go by score."""
    d = v.items(spark, sf_dir)
    d = d.withColumn("energy_gb", F.when(~((F.col("candidate") % 4 == 0) & F.col("variant").startswith("N")), F.col("energy_gb")))
    return scoring.select_topk(scoring.rule_score(scoring.keep_ok(d))).select("candidate", "variant", "item", "topk_position", "selection_mode", "selection_column")


@register("ag2_rollup_variants", v.with_sql(*VARIANTS, select=select_sql("variants", "candidate, variant, n_items, top_k_used, topk_items, best_item", "best_score, mean_score, geometry_score, variant_score, mean_overwide")))
def ag2_rollup_variants(spark, sf_dir):
    return scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir)))).select("candidate", "variant", "n_items", "top_k_used", "topk_items", "best_item", "best_score", "mean_score", "geometry_score", "variant_score", "mean_overwide")


@register("ag3_rollup_candidates", v.with_sql(*CANDIDATES, select=select_sql("candidates", "candidate, n_variants", "final_score, consistency, std_variant_score, mean_mouth_occlusion")))
def ag3_rollup_candidates(spark, sf_dir):
    return scoring.rollup_candidates(scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir))))).select("candidate", "n_variants", "final_score", "consistency", "std_variant_score", "mean_mouth_occlusion")


def fine(spark, sf_dir):
    return v.items(spark, sf_dir).withColumn("candidate", F.col("customer")).withColumn("variant", F.col("order_key").cast("string"))


FINE_ITEMS = f"base{v.ITEMS},\nitems AS (SELECT * REPLACE (customer AS candidate, CAST(order_key AS VARCHAR) AS variant) FROM baseitems)"


@register("ag3_rollup_fine", v.with_sql(FINE_ITEMS, v.SCORED, v.variants_ctes(), v.candidates_ctes(), select=select_sql("candidates", "candidate, n_variants, n_items", "final_score, best_variant_score")))
def ag3_rollup_fine(spark, sf_dir):
    """The roll-up with a candidate for each customer and a variant for each order."""
    scored = scoring.rule_score(scoring.keep_ok(fine(spark, sf_dir)))
    return scoring.rollup_candidates(scoring.rollup_variants(scored)).select("candidate", "n_variants", "n_items", "final_score", "best_variant_score")


@register("ag4_available_mean", v.with_sql(v.ITEMS, select=f"SELECT item, round({v.mean_sql([('anchor_hit_fraction', 0.5), ('mouth_occlusion', 0.3), ('site_distance', 0.2)])}, 6) AS score FROM items"))
def ag4_available_mean(spark, sf_dir):
    from screenspark.functions.columns import weighted_available_mean

    d = v.items(spark, sf_dir)
    return d.select("item", weighted_available_mean([(F.col("anchor_hit_fraction"), 0.5), (F.col("mouth_occlusion"), 0.3), (F.col("site_distance"), 0.2)]).alias("score"))


@register("ag5_consistency", v.with_sql(*VARIANTS, select=f"SELECT candidate, round(greatest(0, least(1, 0.6 * avg(h) + 0.3 * avg(CASE WHEN round(h, 9) >= 0.5 THEN 1.0 ELSE 0.0 END) + 0.1 * (1 - stddev_pop(h)))), 6) AS consistency FROM (SELECT candidate, {v.mean_sql([(f'mean_{c}', w) for c, w in v._CON.items()])} AS h FROM variants) WHERE h IS NOT NULL GROUP BY candidate"))
def ag5_consistency(spark, sf_dir):
    return scoring.rollup_candidates(scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir))))).select("candidate", "consistency")


@register("ag6_robust_scale", v.with_sql(v.ITEMS, v.scaled_ctes("items", "out", ["site_hit_fraction", "mouth_occlusion", "energy_gb"]), select=select_sql("out", "item", "s_site_hit_fraction, s_mouth_occlusion, s_energy_gb")))
def ag6_robust_scale(spark, sf_dir):
    return scoring.robust_scale(v.items(spark, sf_dir), ["site_hit_fraction", "mouth_occlusion", "energy_gb"]).select("item", "s_site_hit_fraction", "s_mouth_occlusion", "s_energy_gb")


@register("src1_stable_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def src1_stable_rows(spark, sf_dir):
    """Required columns checked, and a row index within each source key."""
    from pyspark.sql import Window

    from screenspark.sources.delimited import require

    d = require(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])
    return d.select("o_orderkey", "o_custkey", "o_orderstatus", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("row_index"))


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("src2_numeric_columns", "UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c in _NUMERIC) + " FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE n_finite")
def src2_numeric_columns(spark, sf_dir):
    """The numeric columns of a table whose columns are all text, and how many values each has."""
    d = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    text = d.select(*(F.col(c).cast("string").alias(c) for c in d.columns))
    names = scoring.detect_numeric_columns(text)
    return text.agg(*(F.count(F.col(c).try_cast("double")).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_finite")) for c in names))).alias("x")).select("x.*")


@register("prj1_clean_text", "SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('nan','none','null','na','n/a') THEN '' ELSE trim(event_type) END AS kind, CASE WHEN user_id % 3 = 0 THEN '' ELSE trim(' x' || user_id || ' ') END AS tag FROM events")
def prj1_clean_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("user_id") % 3 == 0, F.lit(" N/A ")).otherwise(F.concat(F.lit(" x"), "user_id", F.lit(" ")))
    return e.select("event_id", clean_text("event_type").alias("kind"), clean_text(raw).alias("tag"))


@register("prj2_finite", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE round(value, 6) END AS num, round(CASE WHEN event_id % 5 <= 1 THEN -1 ELSE value END, 6) AS num_default FROM events")
def prj2_finite(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "abc").otherwise(F.col("value").cast("string"))
    return e.select("event_id", finite(raw).alias("num"), finite(raw, -1.0).alias("num_default"))


@register("prj3_keep_ok", v.with_sql(v.ITEMS, select="SELECT candidate, count(*) AS n FROM items WHERE status = 'ok' GROUP BY candidate"))
def prj3_keep_ok(spark, sf_dir):
    return scoring.keep_ok(v.items(spark, sf_dir).select("candidate", "status")).groupBy("candidate").agg(F.count("*").alias("n"))


@register("prj4_clip", v.with_sql(v.ITEMS, select=f"SELECT item, round({v.clip_sql('mouth_occlusion', '0.2', '0.8')}, 6) AS clipped FROM items"))
def prj4_clip(spark, sf_dir):
    from screenspark.functions.columns import clip

    return v.items(spark, sf_dir).select("item", clip("mouth_occlusion", 0.2, 0.8).alias("clipped"))


@register("prj5_first_nonempty", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS label FROM customer")
def prj5_first_nonempty(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = F.when(F.col("c_custkey") % 2 == 0, F.lit("none")).otherwise(F.col("c_mktsegment"))
    b = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    return c.select("c_custkey", first_nonempty(a, b).alias("label"))


@register("prj6_detect_column", "SELECT p_partkey, 'p_size' AS chosen, CAST(p_size AS DOUBLE) AS value FROM part")
def prj6_detect_column(spark, sf_dir):
    from screenspark.operators.selection import detect_column

    p = table(spark, sf_dir, "part")
    name = detect_column(p, ["final_score", "p_size", "p_retailprice"])
    return p.select("p_partkey", F.lit(name).alias("chosen"), F.col(name).cast("double").alias("value"))


_FEATURES = ["anchor_hit_fraction", "energy_gb", "mouth_occlusion", "overwide", "site_distance", "site_hit_fraction"]


@register("prj7_model_features", v.with_sql(v.ITEMS, select=" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(max({c}), 6) AS highest FROM items" for c in _FEATURES)))
def prj7_model_features(spark, sf_dir):
    """The columns of the items that a model may learn from, with their number of values and the highest."""
    from screenspark.operators.selection import model_features

    d = v.items(spark, sf_dir)
    names = model_features(d, exclude=(*NOT_FEATURES, "candidate", "customer", "order_key"))
    a = d.agg(*(F.count(c).alias(f"n_{c}") for c in names), *(F.max(c).alias(f"m_{c}") for c in names))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("highest")) for c in names))).alias("x")).select("x.*")


@register("prj8_chain_filter", "SELECT DISTINCT 'B:' || l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' UNION SELECT DISTINCT 'B:' || l_partkey FROM lineitem WHERE FALSE")
def prj8_chain_filter(spark, sf_dir):
    from screenspark.operators.residues import filter_chain

    d = table(spark, sf_dir, "lineitem")
    chain = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "B").otherwise("A")
    return filter_chain(d.select(F.concat(chain, F.lit(":"), "l_partkey").alias("key")).distinct(), "B")


@register("fn_tokens", "SELECT c_custkey, replace(replace(lower(trim(c_mktsegment)), '-', '_'), ' ', '_') AS t FROM customer")
def fn_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", token("c_mktsegment").alias("t"))


@register("wn1_ranks_by_group", v.with_sql(*VARIANTS, select="SELECT candidate, variant, CAST(row_number() OVER (PARTITION BY candidate ORDER BY round(variant_score, 9) DESC NULLS LAST, variant) AS INTEGER) AS rank FROM variants"))
def wn1_ranks_by_group(spark, sf_dir):
    d = scoring.rollup_variants(scoring.rule_score(scoring.keep_ok(v.items(spark, sf_dir))))
    return scoring.assign_rank(d, [F.desc_nulls_last(steady("variant_score")), F.asc("variant")], by=["candidate"]).select("candidate", "variant", "rank")


@register("wn12_top_components", v.with_sql(v.ITEMS, select="""SELECT item, array_to_string(list_transform(list_sort(list_filter([{'o': -abs(site_hit_fraction * 0.2), 'n': 'a', 'v': site_hit_fraction * 0.2}, {'o': -abs(anchor_hit_fraction * -0.14), 'n': 'b', 'v': anchor_hit_fraction * -0.14}, {'o': -abs(mouth_occlusion * 0.14), 'n': 'c', 'v': mouth_occlusion * 0.14}, {'o': -abs(site_distance * 0.5), 'n': 'd', 'v': site_distance * 0.5}], lambda x: x.v IS NOT NULL))[1:3], lambda x: x.n), ';') AS top FROM items"""))
def wn12_top_components(spark, sf_dir):
    parts = {"a": F.col("site_hit_fraction") * 0.2, "b": F.col("anchor_hit_fraction") * -0.14, "c": F.col("mouth_occlusion") * 0.14, "d": F.col("site_distance") * 0.5}
    top = scoring.top_components(parts)
    names = F.array_join(F.transform(F.split(top, ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), ";")
    return v.items(spark, sf_dir).select("item", names.alias("top"))


@register("fn_time_or_min", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN CAST(date_trunc('second', ts) AS TIMESTAMP) WHEN event_id % 5 = 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE TIMESTAMP '0001-01-01 00:00:00' END AS t, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 IN (0, 2) THEN CAST(date_trunc('second', ts) AS TIMESTAMP) WHEN event_id % 5 = 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE TIMESTAMP '0001-01-01 00:00:00' END, event_id) AS place FROM events")
def fn_time_or_min(spark, sf_dir):
    """Times from text of several forms; missing ones and other words come before all others."""
    i, ts = F.col("event_id") % 5, F.col("ts")
    text = F.when(i == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(i == 1, F.date_format(ts, " yyyy-MM-dd ")).when(i == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 3, "soon")
    d = table(spark, sf_dir, "events").select("event_id", "user_id", time_or_min(text).alias("t"))
    return d.select("event_id", "t", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("place"))
