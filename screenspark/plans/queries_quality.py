"""Queries: profiles, gates, ledgers, lineage, repair, ordering and unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenspark.operators import decisions as d
from screenspark.operators import quality as q
from screenspark.operators.residues import match_residues, residue_struct, site_summary
from screenspark.plans import views as v
from screenspark.plans.registry import register, select_sql
from screenspark.plans.tables import table

_PROFILE = ["site_hit_fraction", "mouth_occlusion", "site_distance"]
_P = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.05) AS p05, median({c}) AS p50, quantile_cont({c}, 0.95) AS p95, 1 - count({c}) / count(*) AS missing_ratio, (SELECT max(k) FROM (SELECT count(*) AS k FROM items WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) AS top_ratio, count({c}) = 0 AS all_empty FROM items" for c in _PROFILE)


@register("ag9_profile", v.with_sql(v.ITEMS, f"p AS ({_P})", select=select_sql("p", "column_name, n_rows, n, all_empty, top_ratio >= 0.995 AS near_constant", "mean, std, min, max, p05, p50, p95, missing_ratio, top_ratio")))
def ag9_profile(spark, sf_dir):
    return q.profile(v.items(spark, sf_dir), _PROFILE)


@register("ml2_select_features", v.with_sql(v.ITEMS, f"p AS ({_P})", select="SELECT column_name, 1 - missing_ratio >= 0.05 AND missing_ratio <= 0.80 AND top_ratio < 0.995 AND std > 1e-12 AS selected FROM p"))
def ml2_select_features(spark, sf_dir):
    return q.select_features(q.profile(v.items(spark, sf_dir), _PROFILE))


@register("ag10_processing_summary", v.with_sql(v.ITEMS, select="SELECT variant, count(*) AS n_rows, count_if(status = 'ok') AS n_ok, count_if(status <> 'ok') AS n_failed, count_if(has_warning) AS n_warning FROM items GROUP BY variant"))
def ag10_processing_summary(spark, sf_dir):
    return q.processing_summary(v.items(spark, sf_dir), ["variant"])


_GATE = """g AS (SELECT count(*)::DOUBLE AS n, count_if(status <> 'ok') / count(*) AS failed, count_if(has_warning) / count(*) AS warned, count_if(mouth_occlusion IS NULL) / count(*) AS empty, count_if(overwide >= 0.55) / count(*) AS wide, count(DISTINCT label)::DOUBLE AS classes FROM items),
checks AS (SELECT 'row_count' AS "check", CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS value, 1.0 AS threshold FROM g UNION ALL SELECT 'failed_rows', CASE WHEN failed = 0 THEN 'PASS' WHEN failed <= 0.2 THEN 'WARN' ELSE 'FAIL' END, failed, 0.2 FROM g UNION ALL SELECT 'warning_rows', CASE WHEN warned = 0 THEN 'PASS' ELSE 'WARN' END, warned, 0.0 FROM g UNION ALL SELECT 'empty_columns', CASE WHEN empty < 1 THEN 'PASS' ELSE 'WARN' END, empty, 1.0 FROM g UNION ALL SELECT 'overwide', CASE WHEN wide <= 0.3 THEN 'PASS' ELSE 'WARN' END, wide, 0.3 FROM g UNION ALL SELECT 'labels', CASE WHEN classes >= 2 THEN 'PASS' ELSE 'WARN' END, classes, 2.0 FROM g)"""


@register("fl2_quality_gate", v.with_sql(v.ITEMS, _GATE, select='SELECT "check", status, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold FROM checks'))
def fl2_quality_gate(spark, sf_dir):
    return q.quality_gate(v.items(spark, sf_dir), "mouth_occlusion", "overwide", "label")


@register("ag25_worst_status", v.with_sql(v.ITEMS, _GATE, select="SELECT arg_max(status, CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS status FROM checks"))
def ag25_worst_status(spark, sf_dir):
    return q.worst_status(q.quality_gate(v.items(spark, sf_dir), "mouth_occlusion", "overwide", "label"))


def features(spark, sf_dir):
    return v.items(spark, sf_dir).select("candidate", "item", F.col("site_hit_fraction").alias("site_hit_fraction"), (F.col("anchor_hit_fraction") * 10).alias("anchor_hit_fraction"), "mouth_occlusion", (F.col("site_distance") * 12).alias("path_score"), (F.col("site_distance") * 100).alias("mouth_clearance"), "overwide")


_FEATURES = "ft AS (SELECT candidate, item, site_hit_fraction AS site, anchor_hit_fraction * 10 AS anchor, mouth_occlusion AS mouth, site_distance * 12 AS path, site_distance * 100 AS clear, overwide FROM items)"
_FLAGS = """fl AS (SELECT candidate, item, list_filter([CASE WHEN overwide >= 0.55 THEN 'site_overwide' END, CASE WHEN mouth >= 0.6 AND path <= 0.25 THEN 'mouth_high_path_open' END, CASE WHEN path >= 0.6 AND site <= 0.25 THEN 'path_high_site_low' END, CASE WHEN path >= 0.6 AND anchor <= 0.25 THEN 'path_high_anchor_low' END,
CASE WHEN site >= 0.6 AND anchor >= 0.6 AND NOT coalesce(mouth >= 0.6, FALSE) AND NOT path >= 0.6 THEN 'contact_high_block_low' END, CASE WHEN mouth >= 0.6 AND clear >= 4 THEN 'mouth_high_clearance_open' END,
CASE WHEN 3 + CASE WHEN mouth IS NULL THEN 0 ELSE 1 END >= 3 AND greatest(site, anchor, mouth, path) - least(site, anchor, mouth, path) >= 0.55 THEN 'core_disagreement' END], lambda x: x IS NOT NULL) AS f FROM ft)"""


@register("fl1_proxy_flags", v.with_sql(v.ITEMS, _FEATURES, _FLAGS, select="SELECT item, array_to_string(f, '|') AS proxy_flags, CASE WHEN len(f) = 0 THEN 'none' WHEN list_contains(f, 'site_overwide') THEN 'tighten_site' WHEN list_has_any(f, ['mouth_high_path_open', 'mouth_high_clearance_open']) THEN 'check_path' ELSE 'inspect_item' END AS action FROM fl"))
def fl1_proxy_flags(spark, sf_dir):
    return q.proxy_flags(features(spark, sf_dir)).select("item", "proxy_flags", "action")


@register("ag22_flag_audit", v.with_sql(v.ITEMS, _FEATURES, _FLAGS, "k AS (SELECT candidate, u, count(*) AS k FROM (SELECT candidate, unnest(f) AS u FROM fl) GROUP BY ALL)", "t AS (SELECT candidate, string_agg(u, '|' ORDER BY r) AS top_flags FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY k DESC, u) AS r FROM k) WHERE r <= 4 GROUP BY 1)", select="SELECT candidate, n, n_flagged, coalesce(top_flags, '') AS top_flags, round(n_flagged / n, 6) AS flagged_fraction FROM (SELECT candidate, count(*) AS n, count_if(len(f) > 0) AS n_flagged FROM fl GROUP BY 1) LEFT JOIN t USING (candidate)"))
def ag22_flag_audit(spark, sf_dir):
    return q.audit_by_candidate(q.proxy_flags(features(spark, sf_dir)))


@register("so3_risky_rows", v.with_sql(v.ITEMS, select="SELECT item, round(CASE WHEN status <> 'ok' THEN 10 ELSE 0 END + CASE WHEN has_warning THEN 3 ELSE 0 END + overwide, 6) AS risk_score FROM items ORDER BY CASE WHEN status <> 'ok' THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN has_warning THEN 3.0::DOUBLE ELSE 0 END + overwide DESC, item LIMIT 50"))
def so3_risky_rows(spark, sf_dir):
    """A report of the 50 riskiest rows."""
    return q.risky_rows(v.items(spark, sf_dir), 50).select("item", "risk_score")


@register("so1_ordered", v.with_sql(v.ITEMS, select="SELECT candidate, item, row_number() OVER (PARTITION BY candidate ORDER BY mouth_occlusion DESC NULLS LAST, site_distance, item) AS position FROM items"))
def so1_ordered(spark, sf_dir):
    w = Window.partitionBy("candidate").orderBy(F.desc_nulls_last("mouth_occlusion"), "site_distance", "item")
    return v.items(spark, sf_dir).select("candidate", "item", F.row_number().over(w).cast("long").alias("position"))


_KEYS = "keys AS (SELECT DISTINCT chr(CAST(65 + l_partkey % 3 AS INTEGER)) || ':' || l_suppkey || CASE WHEN l_partkey % 5 = 0 THEN ':A' ELSE '' END AS key FROM lineitem)"


def keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.chr(65 + F.col("l_partkey") % 3), F.lit(":"), "l_suppkey", F.when(F.col("l_partkey") % 5 == 0, ":A").otherwise("")).alias("key")).distinct()


@register("so2_residue_order", v.with_sql(_KEYS, select="SELECT key, row_number() OVER (ORDER BY split_part(key, ':', 1), CAST(split_part(key, ':', 2) AS INTEGER), split_part(key, ':', 3)) AS position FROM keys"))
def so2_residue_order(spark, sf_dir):
    k = keys(spark, sf_dir)
    w = Window.partitionBy("_c").orderBy("_s")
    before = k.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("_c")).agg(F.count("*").alias("_n"))
    offset = before.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return k.withColumn("_c", F.split_part("key", F.lit(":"), F.lit(1))).withColumn("_s", residue_struct("key")).join(F.broadcast(offset), "_c").select("key", (F.row_number().over(w) + F.col("_o")).alias("position"))


def _residues(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    chain = F.when(F.col("l_linestatus") == "F", "A").otherwise("B")
    want = F.concat(F.when(F.col("l_partkey") % 4 == 0, "C").when(F.col("l_partkey") % 4 == 1, "").otherwise(chain), F.lit(":"), (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string"), F.when(F.col("l_partkey") % 7 == 0, ":X").otherwise(""))
    res = li.filter("l_quantity > 25").select(F.col("l_suppkey").alias("structure"), F.concat(chain, F.lit(":"), "l_partkey", F.when(F.col("l_tax") > 0.06, ":X").otherwise("")).alias("key")).distinct()
    return li.select(F.col("l_suppkey").alias("structure"), want.alias("key")).distinct(), res


_RES = """w0 AS (SELECT DISTINCT l_suppkey AS structure, CASE WHEN l_partkey % 4 = 0 THEN 'C' WHEN l_partkey % 4 = 1 THEN '' WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END || ':' || (l_partkey + l_linenumber % 2) || CASE WHEN l_partkey % 7 = 0 THEN ':X' ELSE '' END AS key FROM lineitem),
r0 AS (SELECT DISTINCT l_suppkey AS structure, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END || ':' || l_partkey || CASE WHEN l_tax > 0.06 THEN ':X' ELSE '' END AS mk FROM lineitem WHERE l_quantity > 25),
w AS (SELECT *, split_part(key, ':', 1) AS c, CAST(split_part(key, ':', 2) AS INTEGER) AS n, split_part(key, ':', 3) AS i FROM w0), r AS (SELECT *, split_part(mk, ':', 1) AS c, CAST(split_part(mk, ':', 2) AS INTEGER) AS n, split_part(mk, ':', 3) AS i FROM r0),
wl AS (SELECT *, c = '' OR NOT EXISTS (SELECT 1 FROM r WHERE r.structure = w.structure AND r.c = w.c) AS loose FROM w),
u1 AS (SELECT structure, c, n, min(mk) AS mk FROM r GROUP BY ALL HAVING count(*) = 1), u2 AS (SELECT structure, n, i, min(mk) AS mk FROM r GROUP BY ALL HAVING count(*) = 1), u3 AS (SELECT structure, n, min(mk) AS mk FROM r GROUP BY ALL HAVING count(*) = 1),
hits AS (SELECT w.structure, key, 0 AS lv, 'exact' AS mode, mk FROM wl w JOIN r USING (structure, c, n, i) UNION ALL SELECT w.structure, key, 1, 'chain_number', mk FROM wl w JOIN u1 USING (structure, c, n) UNION ALL SELECT w.structure, key, 2, 'any_chain_icode', mk FROM wl w JOIN u2 USING (structure, n, i) WHERE loose UNION ALL SELECT w.structure, key, 3, 'any_chain', mk FROM wl w JOIN u3 USING (structure, n) WHERE loose
 UNION ALL SELECT w.structure, key, 4, 'offset_-1', mk FROM wl w JOIN r ON r.structure = w.structure AND r.c = w.c AND r.n = w.n - 1 AND r.i = w.i UNION ALL SELECT w.structure, key, 5, 'offset_-1', mk FROM wl w JOIN u1 r ON r.structure = w.structure AND r.c = w.c AND r.n = w.n - 1
 UNION ALL SELECT w.structure, key, 6, 'offset_+1', mk FROM wl w JOIN r ON r.structure = w.structure AND r.c = w.c AND r.n = w.n + 1 AND r.i = w.i UNION ALL SELECT w.structure, key, 7, 'offset_+1', mk FROM wl w JOIN u1 r ON r.structure = w.structure AND r.c = w.c AND r.n = w.n + 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure, key ORDER BY lv, mk) AS k FROM hits) WHERE k = 1),
matched AS (SELECT w.structure, w.key, mk AS matched_key, coalesce(mode, 'unmatched') AS mode, coalesce(mode, 'unmatched') <> 'exact' AS warning FROM w LEFT JOIN b ON b.structure = w.structure AND b.key = w.key)"""


@register("jn9_match_residues", v.with_sql(_RES, select="SELECT * FROM matched"))
def jn9_match_residues(spark, sf_dir):
    return match_residues(*_residues(spark, sf_dir))


@register("ag29_site_summary", v.with_sql(_RES, select="SELECT structure, count(*) AS n_defined, count(matched_key) AS n_matched, count_if(matched_key IS NULL) AS n_unmatched, count_if(warning) AS n_warnings, count(DISTINCT split_part(matched_key, ':', 1)) AS n_chains, count(DISTINCT split_part(matched_key, ':', 1)) > 1 AS cross_chain FROM matched GROUP BY structure"))
def ag29_site_summary(spark, sf_dir):
    return site_summary(match_residues(*_residues(spark, sf_dir)))


def ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    status = F.when(t == "signup", "planned").when(t == "view", "in_progress").when(t == "click", "completed").when(t == "error", "blocked").otherwise("")
    return e.select(F.col("user_id").alias("candidate"), F.col("ts").alias("run_time"), F.col("ts").alias("source_time"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("source_priority"), F.col("event_id").alias("row_id"), status.alias("status"), F.when(t == "purchase", "Positive").otherwise("n/a").alias("result"), F.when(F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 2 == 0, "0").otherwise("0.3")).when(F.col("event_id") % 13 == 0, "yes").otherwise(None).alias("validation_label"))


LEDGER = """ledger AS (SELECT user_id AS candidate, ts AS run_time, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS source_priority, event_id AS row_id, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'blocked' ELSE '' END AS status, CASE WHEN event_type = 'purchase' THEN 'positive' ELSE '' END AS result,
CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '0' ELSE '0.3' END WHEN event_id % 13 = 0 THEN 'yes' END AS validation_label FROM events)"""
_LAST = "last AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS n_records, row_number() OVER (PARTITION BY candidate ORDER BY run_time DESC NULLS LAST, source_priority, row_id DESC) AS r FROM ledger) WHERE r = 1)"


@register("wn6_latest_state", v.with_sql(LEDGER, _LAST, select="SELECT candidate, row_id, status, n_records FROM last"))
def wn6_latest_state(spark, sf_dir):
    return d.latest_state(ledger(spark, sf_dir), "candidate", [F.desc_nulls_last("run_time"), F.asc("source_priority"), F.desc("row_id")]).select("candidate", "row_id", "status", "n_records")


@register("sc15_merge_ledgers", v.with_sql(LEDGER, _LAST, select="SELECT candidate, row_id, status, CASE WHEN row_id % 2 = 0 THEN 'include' ELSE 'exclude' END AS override FROM last"))
def sc15_merge_ledgers(spark, sf_dir):
    h = ledger(spark, sf_dir)
    even = h.filter("row_id % 2 = 0").withColumn("plan_override", F.lit("Force-Include"))
    odd = h.filter("row_id % 2 = 1").withColumn("manual", F.lit(" skip "))
    out = d.merge_ledgers(d.union_history(even, odd), {"override": ["plan_override", "manual"]})
    return out.select("candidate", "row_id", "status", "override")


_INFER = """inf AS (SELECT *, CASE WHEN try_cast(validation_label AS DOUBLE) >= 0.5 THEN 1 WHEN try_cast(validation_label AS DOUBLE) <= 0 THEN 0 WHEN validation_label = 'yes' THEN 1 END AS fl, CASE WHEN result = 'positive' THEN 1 END AS fr FROM ledger),
inf2 AS (SELECT *, coalesce(fl, fr) AS inferred_label, coalesce(fl, fr) IS NOT NULL AS ready, CASE WHEN fl IS NOT NULL THEN 'explicit_label' WHEN fr IS NOT NULL THEN 'result' WHEN status = 'completed' THEN 'completed_without_result' WHEN status IN ('planned', 'in_progress') THEN 'open' WHEN status = 'blocked' THEN 'stopped' ELSE 'no_evidence' END AS category FROM inf)"""


@register("sc16_infer_validation", v.with_sql(LEDGER, _INFER, select="SELECT row_id, inferred_label, ready, category, CASE WHEN ready THEN 'calibrate' WHEN category = 'completed_without_result' THEN 'fill_result' WHEN category = 'open' THEN 'wait' ELSE 'ignore' END AS \"use\" FROM inf2"))
def sc16_infer_validation(spark, sf_dir):
    return d.infer_validation(ledger(spark, sf_dir)).select("row_id", "inferred_label", "ready", "category", "use")


_BEST = "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY ready DESC, source_priority, CASE WHEN category = 'open' THEN 1 ELSE 0 END DESC, row_id DESC) AS r FROM inf2) WHERE r = 1)"


def _evidence(spark, sf_dir):
    return d.infer_validation(ledger(spark, sf_dir)).withColumn("status_priority", F.when(F.col("category") == "open", 1).otherwise(0)).select("candidate", "row_id", "ready", "category", "source_priority", "status_priority")


@register("wn7_best_evidence", v.with_sql(LEDGER, _INFER, _BEST, select="SELECT candidate, row_id, ready, category FROM be"))
def wn7_best_evidence(spark, sf_dir):
    return d.best_evidence(_evidence(spark, sf_dir)).select("candidate", "row_id", "ready", "category")


_AUDIT = "au AS (SELECT c_custkey AS candidate, c_custkey <= 60 AS in_top, CASE WHEN coalesce(ready, FALSE) THEN 'none' WHEN source_priority IS NULL THEN 'no_record' WHEN category = 'completed_without_result' THEN 'missing_result' ELSE 'not_finished' END AS gap FROM customer LEFT JOIN be ON be.candidate = c_custkey), au2 AS (SELECT *, CASE WHEN gap = 'none' OR NOT in_top THEN 'none' WHEN gap = 'missing_result' THEN 'record_result' WHEN gap = 'no_record' THEN 'plan_validation' ELSE 'finish_validation' END AS action FROM au)"


def _audit(spark, sf_dir):
    ranked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_custkey").alias("rank"))
    return d.evidence_audit(ranked, _evidence(spark, sf_dir), 60)


@register("sc17_evidence_audit", v.with_sql(LEDGER, _INFER, _BEST, _AUDIT, select="SELECT * FROM au2"))
def sc17_evidence_audit(spark, sf_dir):
    return _audit(spark, sf_dir).select("candidate", "in_top", "gap", "action")


@register("sc17_audit_status", v.with_sql(LEDGER, _INFER, _BEST, _AUDIT, "x AS (SELECT count_if(in_top) AS n_top, count_if(in_top AND gap = 'none') AS n_ready, count_if(action <> 'none') AS n_actions FROM au2)", select="SELECT *, round(n_ready / n_top, 6) AS coverage, CASE WHEN n_ready = 0 THEN 'FAIL' WHEN n_ready / n_top < 0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM x"))
def sc17_audit_status(spark, sf_dir):
    return d.audit_status(_audit(spark, sf_dir))


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at"), F.sha2(F.concat("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")), 256).alias("params"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.sha2("o_orderpriority", 256)).alias("inputs"))


RUNS = "runs AS (SELECT o_orderkey AS run, o_orderdate AS started_at, sha256(o_orderpriority || o_orderstatus || o_custkey) AS params, CASE WHEN o_orderstatus = 'P' THEN '' ELSE sha256(o_orderpriority) END AS inputs FROM orders)"


@register("wn8_lineage_groups", v.with_sql(RUNS, select="SELECT run, lag(run) OVER (PARTITION BY params ORDER BY started_at, run) AS params_previous, count(*) OVER (PARTITION BY params) AS params_size, CASE WHEN inputs <> '' THEN lag(run) OVER (PARTITION BY inputs ORDER BY started_at, run) END AS inputs_previous, CASE WHEN inputs <> '' THEN count(*) OVER (PARTITION BY inputs) END AS inputs_size FROM runs"))
def wn8_lineage_groups(spark, sf_dir):
    return q.lineage_groups(runs(spark, sf_dir), ["params", "inputs"]).select("run", "params_previous", "params_size", "inputs_previous", "inputs_size")


@register("ln4_lineage_edges", v.with_sql(RUNS, select="SELECT run, 'params' AS kind, params AS node FROM runs UNION ALL SELECT run, 'inputs', inputs FROM runs WHERE inputs <> ''"))
def ln4_lineage_edges(spark, sf_dir):
    return q.lineage_edges(runs(spark, sf_dir), ["params", "inputs"])


@register("ln2_verify_manifest", "WITH e AS (SELECT url AS path, CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 7 = 0 THEN sha256('x') ELSE sha256(html) END AS sha256, strlen(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size, page_id FROM pages), d AS (SELECT DISTINCT path, sha256, size, page_id FROM e) SELECT d.page_id, CASE WHEN d.sha256 = '' THEN 'invalid' WHEN d.page_id % 3 = 0 THEN 'missing' WHEN d.page_id % 5 = 0 THEN 'size_mismatch' WHEN d.page_id % 7 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM d")
def ln2_verify_manifest(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("h"), F.octet_length("html").alias("n"))
    bad = F.when(F.col("page_id") % 17 == 0, "").when(F.col("page_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("h"))
    expected = p.select("path", bad.alias("sha256"), (F.col("n") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("size"))
    out = q.verify_manifest(expected, p.filter("page_id % 3 <> 0").select("path", F.col("h").alias("sha256"), F.col("n").alias("size")))
    return out.select(F.col("path").cast("long").alias("page_id"), "status")


_NAME = "CASE WHEN page_id % 11 = 0 THEN 'u' || page_id WHEN page_id % 13 = 0 THEN 'Q' ELSE 'p' || page_id % 40 END"
_TAIL = "CASE WHEN rn <> fn THEN 0 WHEN split_part(r, '/', 3) <> split_part(f, '/', 3) THEN 1 WHEN split_part(r, '/', 2) <> split_part(f, '/', 2) THEN 2 ELSE 3 END"


@register("src13_path_repair", f"""WITH n AS (SELECT page_id, {_NAME} AS name FROM pages), r0 AS (SELECT DISTINCT 'old/h' || page_id % 5 || '/d' || page_id % 4 || '/' || name || '.html' AS ref FROM n WHERE page_id % 2 = 0),
f0 AS (SELECT 'new/H' || page_id % 7 || '/d' || page_id % 6 || '/' || name || CASE WHEN page_id % 40 < 30 THEN '.html' ELSE '.htm' END || CASE WHEN page_id % 29 = 0 THEN '.gz' ELSE '' END AS path FROM n WHERE page_id % 3 <> 0),
p AS (SELECT ref, path, lower(ref) AS r, lower(path) AS f, split_part(lower(ref), '/', 4) AS rn, split_part(lower(path), '/', 4) AS fn FROM r0 JOIN f0 ON regexp_replace(split_part(lower(ref), '/', 4), '[.][^.]*$', '') = regexp_replace(split_part(lower(path), '/', 4), '[.][^.]*$', '') OR split_part(lower(ref), '/', 4) = split_part(lower(path), '/', 4)),
t AS (SELECT *, {_TAIL} AS tail, max(rn = fn) OVER (PARTITION BY ref) AS named FROM p), k AS (SELECT * FROM t WHERE NOT named OR rn = fn),
b AS (SELECT *, count(*) OVER (PARTITION BY ref) AS candidates, max(tail) OVER (PARTITION BY ref) AS best FROM k),
u AS (SELECT *, count(*) OVER (PARTITION BY ref, tail) AS same, row_number() OVER (PARTITION BY ref ORDER BY tail DESC, f, path) AS o FROM b)
SELECT ref, path, reason, candidates, CASE reason WHEN 'unique_name' THEN 0.96 WHEN 'name_and_context' THEN 0.90 WHEN 'name_best_context' THEN 0.78 WHEN 'several_names' THEN 0.58 WHEN 'unique_stem' THEN 0.72 ELSE 0.45 END::DOUBLE AS confidence, reason IN ('unique_name', 'name_and_context', 'name_best_context', 'unique_stem') AS auto
FROM (SELECT *, CASE WHEN named AND candidates = 1 THEN 'unique_name' WHEN named AND best >= 2 AND same = 1 THEN 'name_and_context' WHEN named AND same = 1 THEN 'name_best_context' WHEN named THEN 'several_names' WHEN candidates = 1 THEN 'unique_stem' ELSE 'several_stems' END AS reason FROM u WHERE o = 1)""")
def src13_path_repair(spark, sf_dir):
    """Broken references to pages matched to a listing with other folders, shared names and other endings."""
    i = F.col("page_id")
    name = F.when(i % 11 == 0, F.concat(F.lit("u"), i)).when(i % 13 == 0, F.lit("Q")).otherwise(F.concat(F.lit("p"), i % 40))
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    refs = p.filter("page_id % 2 = 0").select(F.concat(F.lit("old/h"), i % 5, F.lit("/d"), i % 4, F.lit("/"), "name", F.lit(".html")).alias("ref"))
    files = p.filter("page_id % 3 <> 0").select(F.concat(F.lit("new/H"), i % 7, F.lit("/d"), i % 6, F.lit("/"), "name", F.when(i % 40 < 30, ".html").otherwise(".htm"), F.when(i % 29 == 0, ".gz").otherwise("")).alias("path"))
    return q.plan_path_repair(refs, files)


@register("src14_representative_item", v.with_sql(v.ITEMS, select="SELECT candidate, coalesce(arg_min(item, (mouth_occlusion, item)) FILTER (WHERE mouth_occlusion IS NOT NULL), min(item)) AS item FROM items GROUP BY candidate"))
def src14_representative_item(spark, sf_dir):
    return q.representative_item(v.items(spark, sf_dir), "mouth_occlusion")


@register("st1_union_history", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::DOUBLE AS quantity FROM orders UNION ALL SELECT l_orderkey, NULL, l_quantity FROM lineitem")
def st1_union_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return d.union_history(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity")))


@register("st3_dedup_last", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def st3_dedup_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return d.latest_state(e, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@register("ag21_group_means", v.with_sql(v.ITEMS, select="SELECT variant, status, count(*) AS n, round(avg(site_distance), 6) AS mean_distance, round(avg(overwide), 6) AS mean_overwide FROM items GROUP BY ALL"))
def ag21_group_means(spark, sf_dir):
    return v.items(spark, sf_dir).groupBy("variant", "status").agg(F.count("*").alias("n"), F.avg("site_distance").alias("mean_distance"), F.avg("overwide").alias("mean_overwide"))
