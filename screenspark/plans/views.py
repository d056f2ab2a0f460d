"""The engine's tables over the given data folder, in Spark and as SQL.

Items are order lines: a candidate is a supplier, a variant a pair of line flags,
an item a line.  The SQL strings are lists of common table expressions with the
same content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.plans.staging import stage
from screenspark.plans.tables import table


#: The columns of items that a ranking and its quality counts look at.
RANKED = ("candidate", "variant", "item", "site_hit_fraction", "anchor_hit_fraction", "mouth_occlusion", "site_distance", "energy_gb", "overwide", "status", "has_warning")


def items(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """All items; with ``together``, the rows of a candidate lie in one partition."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    d = line.join(orders, line["l_orderkey"] == orders["o_orderkey"], "left")
    if together:
        d = d.repartition("l_suppkey")
    return d.select(
        F.col("l_suppkey").alias("candidate"), F.concat("l_returnflag", "l_linestatus").alias("variant"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("item"),
        (F.col("l_quantity") / 50).alias("site_hit_fraction"), F.col("l_discount").alias("anchor_hit_fraction"),
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity") / 50).alias("mouth_occlusion"),
        F.col("l_tax").alias("site_distance"), F.col("l_extendedprice").alias("energy_gb"), (F.col("l_tax") * 10).alias("overwide"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), (F.col("l_linenumber") == 1).alias("has_warning"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("label"), F.col("o_custkey").alias("customer"), F.col("l_orderkey").alias("order_key"), F.col("l_shipdate").alias("ship_date"),
    )


def ranked_items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The items' columns for a ranking (and ``more``), staged with the rows of a candidate together.

    What is counted or selected for each candidate is then complete within a task, so
    later shuffles carry rows of groups, however many tasks there are.
    """
    return stage(items(spark, sf_dir, together=True).select(*RANKED, *more), "items")


ITEMS = """items AS (
  SELECT l_suppkey AS candidate, l_returnflag || l_linestatus AS variant,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS item,
    l_quantity / 50 AS site_hit_fraction, l_discount AS anchor_hit_fraction,
    CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity / 50 END AS mouth_occlusion,
    l_tax AS site_distance, l_extendedprice AS energy_gb, l_tax * 10 AS overwide,
    CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, l_linenumber = 1 AS has_warning,
    CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, o_custkey AS customer, l_orderkey AS order_key, l_shipdate AS ship_date
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""


def clip_sql(x: str, lo: str = "0", hi: str = "1") -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


def mean_sql(terms: list[tuple[str, float]]) -> str:
    """Weighted mean over the terms that are not NULL."""
    top = " + ".join(f"coalesce(({t}) * {w}, 0)" for t, w in terms)
    weight = " + ".join(f"CASE WHEN ({t}) IS NOT NULL THEN {w} ELSE 0 END" for t, w in terms)
    return f"(CASE WHEN ({weight}) > 0 THEN ({top}) / ({weight}) END)"


def scaled_ctes(source: str, out: str, cols: list[str], where: str = "TRUE") -> str:
    """CTEs: ``out`` is ``source`` with s_<col> of each column."""
    bounds = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in cols)
    values = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN hi_{c} - lo_{c} < 1e-12 THEN 0.5 ELSE greatest(0, least(1, ({c} - lo_{c}) / (hi_{c} - lo_{c}))) END AS s_{c}" for c in cols)
    drop = ", ".join(f"lo_{c}, hi_{c}" for c in cols)
    return f"{out}_b AS (SELECT {bounds} FROM {source} WHERE {where}), {out} AS (SELECT * EXCLUDE ({drop}) FROM (SELECT *, {values} FROM {source}, {out}_b WHERE {where}))"


_RULE = {"site_hit_fraction": (1, 0.20), "anchor_hit_fraction": (1, 0.14), "mouth_occlusion": (1, 0.14), "site_distance": (-1, 0.08), "energy_gb": (-1, 0.05)}
_RAW = mean_sql([(f"s_{c}" if s > 0 else f"1 - s_{c}", w) for c, (s, w) in _RULE.items()])
#: items with a rule score; only ok rows if there are any.
SCORED = f"""okitems AS (SELECT * FROM items WHERE status = 'ok' OR NOT (SELECT coalesce(bool_or(status = 'ok'), FALSE) FROM items)),
{scaled_ctes("okitems", "scaled", list(_RULE))},
rawscore AS (SELECT *, {_RAW} AS raw FROM scaled),
scored AS (SELECT * EXCLUDE (raw), greatest(0, least(1, coalesce(raw, (SELECT coalesce(median(raw), 0.5) FROM rawscore)))) AS rule_score FROM rawscore)"""

_GEO = {"site_hit_fraction": 0.34, "anchor_hit_fraction": 0.25, "mouth_occlusion": 0.16}
_CON = {"site_hit_fraction": 0.34, "anchor_hit_fraction": 0.26, "mouth_occlusion": 0.16}


def variants_ctes(source: str = "scored", score: str = "rule_score", out: str = "variants", k: int = 3, penalty: float = 0.0, energy: bool = True) -> str:
    """CTEs: ``out`` has one row for each variant of ``source``."""
    first = "energy_gb ASC NULLS LAST, " if energy else ""
    geo = mean_sql([(f"aux_{c}", w) for c, w in _GEO.items()])
    sev = "CASE WHEN mean_overwide IS NULL OR mean_overwide <= 0.55 THEN 0 ELSE least(1, (mean_overwide - 0.55) / 0.45) END"
    return f"""{scaled_ctes(f"(SELECT * EXCLUDE (s_site_hit_fraction, s_anchor_hit_fraction, s_mouth_occlusion) FROM {source})", f"{out}_s", list(_GEO))},
{out}_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, variant ORDER BY {first}round({score}, 9) DESC NULLS LAST, item) AS topk_position FROM {out}_s) WHERE topk_position <= {k}),
{out}_a AS (SELECT candidate, variant, count(*) AS top_k_used, string_agg(item, '|' ORDER BY topk_position) AS topk_items, min_by(item, topk_position) AS best_item, min_by({score}, topk_position) AS best_score, avg({score}) AS mean_score,
  avg(site_hit_fraction) AS mean_site_hit_fraction, avg(anchor_hit_fraction) AS mean_anchor_hit_fraction, avg(mouth_occlusion) AS mean_mouth_occlusion, avg(overwide) AS mean_overwide,
  {", ".join(f"avg(s_{c}) AS aux_{c}" for c in _GEO)} FROM {out}_t GROUP BY ALL),
{out}_n AS (SELECT candidate, variant, count(*) AS n_items FROM {out}_s GROUP BY ALL),
{out}_g AS (SELECT *, {geo} AS geometry_score FROM {out}_a),
{out} AS (SELECT * EXCLUDE (aux_site_hit_fraction, aux_anchor_hit_fraction, aux_mouth_occlusion), greatest(0, least(1, (CASE WHEN geometry_score IS NULL THEN 1 ELSE 0.85 END) * (0.7 * mean_score + 0.3 * best_score) + (CASE WHEN geometry_score IS NULL THEN 0 ELSE 0.15 END) * coalesce(geometry_score, 0) - {penalty} * ({sev}))) AS variant_score FROM {out}_g JOIN {out}_n USING (candidate, variant))"""


def candidates_ctes(source: str = "variants", out: str = "candidates", weights=(0.50, 0.25, 0.20, 0.15)) -> str:
    """CTEs: ``out`` has one ranked row for each candidate of ``source``."""
    hit = mean_sql([(clip_sql(f"mean_{c}"), w) for c, w in _CON.items()])
    w1, w2, w3, w4 = weights
    return f"""{out}_h AS (SELECT *, {hit} AS hit FROM {source}),
{out}_a AS (SELECT candidate, count(*) AS n_variants, CAST(sum(n_items) AS BIGINT) AS n_items, avg(variant_score) AS mean_variant_score, max(variant_score) AS best_variant_score,
  arg_max(variant, (round(variant_score, 9), variant)) AS best_variant, stddev_pop(variant_score) AS std_variant_score, avg(hit) AS m, avg(CASE WHEN round(hit, 9) >= 0.5 THEN 1.0 WHEN hit IS NOT NULL THEN 0.0 END) AS sh, stddev_pop(hit) AS sd,
  avg(mean_site_hit_fraction) AS mean_site_hit_fraction, avg(mean_anchor_hit_fraction) AS mean_anchor_hit_fraction, avg(mean_mouth_occlusion) AS mean_mouth_occlusion, avg(mean_overwide) AS mean_overwide FROM {out}_h GROUP BY candidate),
{out}_c AS (SELECT * EXCLUDE (m, sh, sd), greatest(0, least(1, 0.60 * m + 0.30 * sh + 0.10 * (1 - greatest(0, least(1, sd))))) AS consistency FROM {out}_a),
{out}_f AS (SELECT *, {w1} * mean_variant_score + {w2} * best_variant_score + {w3} * coalesce(consistency, 0) - {w4} * std_variant_score AS final_score FROM {out}_c),
{out} AS (SELECT *, CAST(row_number() OVER (ORDER BY round(final_score, 9) DESC NULLS LAST, round(best_variant_score, 9) DESC NULLS LAST, candidate) AS INTEGER) AS rank FROM {out}_f)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
