"""Queries: method sets, coverage, evidence and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import sets as s
from screenspark.operators import spatial as g
from screenspark.plans import views as v
from screenspark.plans.registry import register, select_sql
from screenspark.plans.tables import table

METHODS = ["A", "N", "R"]


def method_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("key")).distinct()


def truth(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("key"))
    return method_sets(spark, sf_dir).select("structure", "key").distinct().join(p, "key", "left_semi").select("structure", "key")


SETS = "ms AS (SELECT DISTINCT l_suppkey AS structure, l_returnflag AS method, l_partkey AS key FROM lineitem), truth AS (SELECT DISTINCT structure, key FROM ms WHERE key IN (SELECT p_partkey FROM part WHERE p_size <= 10))"
ACC = "CASE WHEN n_truth > 0 THEN round(n_hit / n_truth, 6) END AS coverage, CASE WHEN n_predicted > 0 THEN round(n_hit / n_predicted, 6) END AS precision, CASE WHEN n_predicted + n_truth - n_hit > 0 THEN round(n_hit / (n_predicted + n_truth - n_hit), 6) END AS jaccard, CASE WHEN n_predicted + n_truth > 0 THEN round(2 * n_hit / (n_predicted + n_truth), 6) END AS f1, CASE WHEN n_truth > 0 THEN round(0.6 * n_hit / n_truth + 0.4 * coalesce(n_hit / n_predicted, 0), 6) END AS utility"


@register("ag16_method_consensus", v.with_sql(SETS, select="SELECT structure, key, count(*) AS support, bool_or(method = 'A') AS \"in_A\", bool_or(method = 'N') AS \"in_N\", bool_or(method = 'R') AS \"in_R\", n_methods, round(count(*) / n_methods, 6) AS fraction, count(*) >= least(n_methods, greatest(2, ceil(0.5 * n_methods))) AS consensus, count(*) = 1 AS specific FROM ms JOIN (SELECT structure, count(DISTINCT method) AS n_methods FROM ms GROUP BY 1) USING (structure) GROUP BY structure, key, n_methods"))
def ag16_method_consensus(spark, sf_dir):
    return s.method_consensus(method_sets(spark, sf_dir), METHODS, 2, 0.5)


@register("ag17_method_summary", v.with_sql(SETS, "k AS (SELECT structure, key, count(*) AS k FROM ms GROUP BY ALL)", "g AS (SELECT structure, method, count(*) AS n, count_if(k >= 2) AS n_consensus, count_if(k = 1) AS n_specific, count(t.key) AS n_truth_hit FROM ms JOIN k USING (structure, key) LEFT JOIN truth t ON t.structure = ms.structure AND t.key = ms.key GROUP BY ms.structure, method)".replace("SELECT structure, method", "SELECT ms.structure, method"), "h AS (SELECT *, n / median(n) OVER (PARTITION BY structure) AS size_ratio FROM g LEFT JOIN (SELECT structure, count(*) AS nt FROM truth GROUP BY 1) USING (structure))",
    select="SELECT structure, method, n, n_consensus, n_specific, n_truth_hit, round(size_ratio, 6) AS size_ratio, round(n_truth_hit / nt, 6) AS coverage, round(n_truth_hit / n, 6) AS precision, round(round(least(1, 0.7 * greatest(0, least(1, (size_ratio - 1) / 2)) + 0.3 * n_specific / n), 9), 6) AS overwide_risk FROM h"))
def ag17_method_summary(spark, sf_dir):
    return s.method_summary(method_sets(spark, sf_dir), truth(spark, sf_dir)).withColumn("overwide_risk", F.round("overwide_risk", 9))


@register("ag18_pairwise_jaccard", v.with_sql(SETS, "z AS (SELECT structure, method, count(*) AS n FROM ms GROUP BY ALL)", "sh AS (SELECT x.structure, x.method AS l, y.method AS r, count(*) AS k FROM ms x JOIN ms y ON x.structure = y.structure AND x.key = y.key AND x.method < y.method GROUP BY ALL)", select="SELECT a.structure, a.method AS \"left\", b.method AS \"right\", a.n AS n_left, b.n AS n_right, coalesce(k, 0) AS n_shared, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 6) AS jaccard, round(coalesce(k, 0) / a.n, 6) AS left_overlap, round(coalesce(k, 0) / b.n, 6) AS right_overlap FROM z a JOIN z b ON a.structure = b.structure AND a.method < b.method LEFT JOIN sh ON sh.structure = a.structure AND l = a.method AND r = b.method"))
def ag18_pairwise_jaccard(spark, sf_dir):
    return s.pairwise_jaccard(method_sets(spark, sf_dir))


@register("ag19_set_accuracy", v.with_sql(SETS, "a AS (SELECT structure, method, count(*) AS n_predicted, count(t.key) AS n_hit FROM ms LEFT JOIN truth t USING (structure, key) GROUP BY ALL)", "b AS (SELECT structure, method, n_predicted, coalesce(nt, 0) AS n_truth, n_hit FROM a LEFT JOIN (SELECT structure, count(*) AS nt FROM truth GROUP BY 1) USING (structure))", select=f"SELECT structure, method, n_predicted, n_truth, n_hit, {ACC} FROM b"))
def ag19_set_accuracy(spark, sf_dir):
    return s.set_accuracy(method_sets(spark, sf_dir), truth(spark, sf_dir), ["structure", "method"])


_SUP = "k AS (SELECT structure, key, count(*) AS k FROM ms GROUP BY ALL), c AS (SELECT min_count, structure, count(*) AS n_predicted, count(t.key) AS n_hit FROM k LEFT JOIN truth t USING (structure, key), (SELECT unnest([1, 2, 3]) AS min_count) WHERE k >= min_count GROUP BY ALL), d AS (SELECT min_count, structure, n_predicted, coalesce(nt, 0) AS n_truth, n_hit FROM c LEFT JOIN (SELECT structure, count(*) AS nt FROM truth GROUP BY 1) USING (structure)), sw AS (SELECT min_count, structure, n_predicted, n_truth, n_hit, " + ACC + " FROM d)"


@register("sc5_support_sweep", v.with_sql(SETS, _SUP, select="SELECT * FROM sw"))
def sc5_support_sweep(spark, sf_dir):
    return s.sweep_support(method_sets(spark, sf_dir), truth(spark, sf_dir), [1, 2, 3])


@register("wn13_best_scenario", v.with_sql(SETS, _SUP, select="SELECT structure, min_count, utility FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY utility DESC NULLS LAST, coverage DESC NULLS LAST, precision DESC NULLS LAST, min_count) AS r FROM sw) WHERE r = 1"))
def wn13_best_scenario(spark, sf_dir):
    d = s.sweep_support(method_sets(spark, sf_dir), truth(spark, sf_dir), [1, 2, 3])
    return s.best_by_group(d.select("structure", "min_count", *(F.round(x, 6).alias(x) for x in ("utility", "coverage", "precision"))), "structure").select("structure", "min_count", "utility")


@register("sc6_penalty_sweep", v.with_sql(v.ITEMS, select="SELECT weight, candidate, round(greatest(0, least(1, u - weight * r)), 6) AS adjusted FROM (SELECT candidate, avg(anchor_hit_fraction) * 10 AS u, avg(overwide) AS r FROM items GROUP BY 1), (SELECT unnest([0.0, 0.15, 0.3]::DOUBLE[]) AS weight)"))
def sc6_penalty_sweep(spark, sf_dir):
    d = v.items(spark, sf_dir).groupBy("candidate").agg((F.avg("anchor_hit_fraction") * 10).alias("utility"), F.avg("overwide").alias("overwide_risk"))
    return s.penalty_sweep(d, [0.0, 0.15, 0.30]).select("weight", "candidate", "adjusted")


@register("jn10_set_differences", v.with_sql(SETS, select="SELECT structure, key, 'missing' AS kind FROM truth t WHERE NOT EXISTS (SELECT 1 FROM ms WHERE method = 'A' AND ms.structure = t.structure AND ms.key = t.key) UNION ALL SELECT structure, key, 'extra' FROM ms WHERE method = 'A' AND NOT EXISTS (SELECT 1 FROM truth t WHERE ms.structure = t.structure AND ms.key = t.key)"))
def jn10_set_differences(spark, sf_dir):
    return s.set_differences(method_sets(spark, sf_dir).filter("method = 'A'").select("structure", "key"), truth(spark, sf_dir))


@register("st2_set_operations", v.with_sql(SETS, select="SELECT (SELECT count(*) FROM (SELECT structure, key FROM ms WHERE method = 'A' INTERSECT SELECT structure, key FROM ms WHERE method = 'R')) AS n_both, (SELECT count(*) FROM (SELECT structure, key FROM ms WHERE method = 'A' UNION SELECT structure, key FROM ms WHERE method = 'R')) AS n_any, (SELECT count(*) FROM (SELECT structure, key FROM ms WHERE method = 'A' EXCEPT SELECT structure, key FROM ms WHERE method = 'R')) AS n_only"))
def st2_set_operations(spark, sf_dir):
    d = method_sets(spark, sf_dir)
    a, r = (d.filter(F.col("method") == m).select("structure", "key") for m in "AR")
    n = lambda x, c: x.agg(F.count("*").alias(c))
    return n(a.intersect(r), "n_both").join(n(a.union(r).distinct(), "n_any")).join(n(a.subtract(r), "n_only"))


EVIDENCE = "ev AS (SELECT l_suppkey AS structure, l_partkey AS key, l_returnflag AS method, l_linestatus AS source, l_discount * 10 AS weight, l_tax AS distance, l_linenumber = 7 AS curated, l_linestatus = 'O' AS external FROM lineitem)"


def evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("source"), (F.col("l_discount") * 10).alias("weight"), F.col("l_tax").alias("distance"), (F.col("l_linenumber") == 7).alias("curated"), (F.col("l_linestatus") == "O").alias("external"))


@register("ag13_evidence_support", v.with_sql(EVIDENCE, "g AS (SELECT structure, key, round(sum(weight), 9) AS support, count(*) AS n_evidence, count(DISTINCT method) AS n_methods, count_if(weight >= 0.75) AS n_high, max(weight) AS max_weight, min(distance) AS min_distance, string_agg(DISTINCT method, '|' ORDER BY method) AS methods, bool_or(curated) AS curated FROM ev GROUP BY ALL)",
    select="SELECT structure, key, round(support, 6) AS support, n_evidence, n_methods, n_high, round(max_weight, 6) AS max_weight, round(min_distance, 6) AS min_distance, methods, curated, curated OR support >= 1 AS supported, array_to_string(list_filter([CASE WHEN n_methods = 1 THEN 'single_method' END, CASE WHEN support < 1 THEN 'low_support' END, CASE WHEN NOT curated THEN 'not_curated' END], lambda x: x IS NOT NULL), '|') AS review FROM g"))
def ag13_evidence_support(spark, sf_dir):
    return s.aggregate_support(evidence(spark, sf_dir).withColumn("weight", F.col("weight").cast("decimal(18,9)")), 1.0).withColumn("support", F.col("support").cast("double")).withColumn("max_weight", F.col("max_weight").cast("double"))


@register("ag14_precision_guard", v.with_sql(EVIDENCE, "n AS (SELECT structure, count(DISTINCT key) AS n FROM ev GROUP BY 1), w AS (SELECT structure, source FROM ev JOIN n USING (structure) WHERE external GROUP BY structure, source, n HAVING count(DISTINCT key) > greatest(20, ceil(0.5 * n)))", select="SELECT DISTINCT structure, key FROM ev WHERE external AND (structure, source) IN (SELECT (structure, source) FROM w) AND (structure, key) NOT IN (SELECT (structure, key) FROM ev WHERE NOT external)"))
def ag14_precision_guard(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return s.precision_guard(e, e.groupBy("structure").agg(F.countDistinct("key").alias("n")), 20, 0.5)


@register("ag15_source_audit", "SELECT c_custkey AS key, c_nationkey AS source, array_to_string(list_filter([CASE WHEN n_name IS NULL AND id IS NULL THEN 'missing_source' END, CASE WHEN n_name IS NULL THEN 'no_reference' END, CASE WHEN coalesce(id, '') = '' THEN 'no_identifier' END, CASE WHEN q < 0.5 THEN 'low_quality' END], lambda x: x IS NOT NULL), '|') AS issues FROM customer LEFT JOIN (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS id, n_regionkey / 4 AS q FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def ag15_source_audit(spark, sf_dir):
    src = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("reference"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("identifier"), (F.col("n_regionkey") / 4).alias("quality"))
    return s.source_audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("source")), src).select("key", "source", "issues")


EXPECTED = "ex AS (SELECT n_nationkey AS id, m AS method FROM nation, (SELECT unnest(['low', 'high']) AS m)), re AS (SELECT s_nationkey AS id, CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'low' ELSE 'debt' END AS method, s_name AS path FROM supplier), cov AS (SELECT coalesce(ex.id, r.id) AS id, coalesce(ex.method, r.method) AS method, CASE WHEN ex.id IS NULL THEN 'unexpected' WHEN r.id IS NULL THEN 'missing' ELSE 'ready' END AS status, coalesce(n, 0) AS n_files, coalesce(paths, '') AS paths FROM ex FULL JOIN (SELECT id, method, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM re GROUP BY ALL) r ON ex.id = r.id AND ex.method = r.method)"


def cover(spark, sf_dir):
    ex = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.lit("low"), F.lit("high"))).alias("method"))
    m = F.when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "low").otherwise("debt")
    return s.coverage(ex, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), m.alias("method"), F.col("s_name").alias("path")))


@register("jn11_coverage", v.with_sql(EXPECTED, select="SELECT * FROM cov"))
def jn11_coverage(spark, sf_dir):
    return cover(spark, sf_dir)


@register("fl10_return_gate", v.with_sql(EXPECTED, "c AS (SELECT count_if(status = 'ready') AS n_ready, count_if(status = 'missing') AS n_missing, count_if(status = 'unexpected') AS n_unexpected FROM cov)", select="SELECT *, CASE WHEN n_ready + n_missing = 0 THEN 'FAIL_NOTHING_EXPECTED' WHEN n_ready = 0 THEN 'FAIL_NOTHING_RETURNED' WHEN n_missing > 0 THEN 'WARN_PARTIAL' WHEN n_unexpected > 0 THEN 'WARN_UNEXPECTED' ELSE 'PASS' END AS decision FROM c"))
def fl10_return_gate(spark, sf_dir):
    return s.return_gate(cover(spark, sf_dir))


@register("jn12_action_plan", v.with_sql(EXPECTED, "p AS (SELECT cov.id, cov.method, status, CASE WHEN status = 'unexpected' THEN 'review_unexpected' WHEN NOT coalesce(n_regionkey < 3, FALSE) THEN 'fix_input' WHEN status = 'missing' THEN 'run_tool' WHEN NOT (cov.method = 'low' AND cov.id % 2 = 0) THEN 'add_to_manifest' ELSE 'run_benchmark' END AS action FROM cov LEFT JOIN nation ON n_nationkey = cov.id)", select="SELECT *, CASE action WHEN 'fix_input' THEN 1 WHEN 'run_tool' THEN 2 WHEN 'add_to_manifest' THEN 3 WHEN 'review_unexpected' THEN 4 ELSE 5 END AS priority FROM p"))
def jn12_action_plan(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return s.action_plan(cover(spark, sf_dir), n.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") < 3).alias("input_ok")), n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.lit("low").alias("method")))


@register("pv1_expansion_plan", v.with_sql(EXPECTED, select="SELECT id, method, CASE WHEN EXISTS (SELECT 1 FROM re WHERE re.id = ex.id AND re.method = ex.method) THEN 'complete' WHEN method = 'low' AND id % 2 = 0 THEN 'manifest_ready' ELSE 'needs_' || method END AS status FROM ex"))
def pv1_expansion_plan(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    done = cover(spark, sf_dir).filter("status <> 'missing'").select("id", "method")
    return s.expansion_plan(n.select(F.col("n_nationkey").alias("id"), F.array(F.lit("low"), F.lit("high")).alias("methods")), n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.lit("low").alias("method")), done)


def atoms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    xyz = [(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")]
    return e.select((F.col("vec_id") % 5).alias("structure"), F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "target").otherwise("partner").alias("role"), *xyz, F.col("label"))


ATOMS = "atoms AS (SELECT vec_id % 5 AS structure, vec_id AS id, CASE WHEN label < 5 THEN 'target' ELSE 'partner' END AS role, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z, label FROM embeddings), site AS (SELECT * FROM atoms WHERE label IN (0, 1)), anchor AS (SELECT * FROM atoms WHERE label = 0), target AS (SELECT * FROM atoms WHERE role = 'target'), partner AS (SELECT *, id AS pid FROM atoms WHERE role = 'partner')"
_D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
NEAR = "near AS (SELECT structure, id, arg_min(pid, (d, pid)) AS pid, min(d) AS dist FROM (SELECT a.structure, a.id, b.id AS pid, " + _D + " AS d FROM {a} a JOIN {b} b ON a.structure = b.structure) GROUP BY ALL)"


def _parts(spark, sf_dir):
    d = atoms(spark, sf_dir)
    return d, d.filter("label IN (0, 1)"), d.filter("role = 'target'"), d.filter("role = 'partner'").withColumn("pid", F.col("id"))


@register("jn5_distance_join", v.with_sql(ATOMS, select=f"SELECT a.structure, a.id, b.id AS pid, round({_D}, 6) AS dist FROM target a JOIN partner b ON a.structure = b.structure WHERE {_D} <= 1.5"))
def jn5_distance_join(spark, sf_dir):
    _, _, t, p = _parts(spark, sf_dir)
    return g.distance_join(t, p, 1.5, ["id"], ["pid"])


@register("jn6_nearest_join", v.with_sql(ATOMS, NEAR.format(a="target", b="partner"), select=select_sql("near", "structure, id, pid", "dist")))
def jn6_nearest_join(spark, sf_dir):
    _, _, t, p = _parts(spark, sf_dir)
    return g.nearest_join(t, p, "id", "pid", 1.5)


@register("ge1_residue_min_distance", v.with_sql(ATOMS, NEAR.format(a="site", b="partner"), select=select_sql("near", "structure, id", "dist")))
def ge1_residue_min_distance(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return g.nearest_join(site, p, "id", "pid").select("structure", "id", "dist")


_CONTACT = "SELECT n.structure, n_site, n_hit, round(mind, 6) AS min_distance, round(mm, 6) AS mean_min_distance, coalesce(nc, 0) AS n_contacts, round(n_hit / n_site, 6) AS hit_fraction, n_hit > 0 AS blocked FROM (SELECT structure, count(*) AS n_site, count_if(dist <= 1.5) AS n_hit, min(dist) AS mind, avg(dist) AS mm FROM near GROUP BY 1) n LEFT JOIN (SELECT a.structure, count(*) AS nc FROM {a} a JOIN partner b ON a.structure = b.structure WHERE " + _D + " <= 1.5 GROUP BY 1) c ON c.structure = n.structure"


@register("ge2_site_contact", v.with_sql(ATOMS, NEAR.format(a="site", b="partner"), select=_CONTACT.format(a="site")))
def ge2_site_contact(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return g.site_contact(site, p, 1.5)


@register("ge3_anchor_contact", v.with_sql(ATOMS, NEAR.format(a="anchor", b="partner"), select=_CONTACT.format(a="anchor")))
def ge3_anchor_contact(spark, sf_dir):
    d, _, _, p = _parts(spark, sf_dir)
    return g.site_contact(d.filter("label = 0"), p, 1.5)


@register("ge4_anchor_shells", v.with_sql(ATOMS, "ta AS (SELECT structure, id, min(d) AS ta FROM (SELECT a.structure, a.id, " + _D + " AS d FROM target a JOIN anchor b ON a.structure = b.structure) GROUP BY ALL)", "tp AS (SELECT structure, id, min(d) AS tp FROM (SELECT a.structure, a.id, " + _D + " AS d FROM target a JOIN partner b ON a.structure = b.structure) GROUP BY ALL)",
    "sh AS (SELECT structure, radius, count(*) AS n_shell, count_if(tp <= 1.5) AS n_hit, min(tp) AS md FROM ta LEFT JOIN tp USING (structure, id), (SELECT unnest([2.0, 4.0]::DOUBLE[]) AS radius) WHERE ta <= radius GROUP BY ALL)", "s2 AS (SELECT *, n_shell / n_target AS fraction FROM sh JOIN (SELECT structure, count(*) AS n_target FROM ta GROUP BY 1) USING (structure))",
    "s3 AS (SELECT *, 0.45 * greatest(0, least(1, (n_shell - 24) / 48)) + 0.40 * greatest(0, least(1, (fraction - 0.18) / 0.32)) + 0.15 * greatest(0, least(1, (radius - 6) / 6)) AS overwide FROM s2)", select="SELECT structure, radius, n_shell, n_hit, n_target, round(md, 6) AS min_distance, round(fraction, 6) AS fraction, round(n_hit / n_shell, 6) AS hit_fraction, round(overwide, 6) AS overwide, overwide >= 0.55 AS overwide_flag FROM s3"))
def ge4_anchor_shells(spark, sf_dir):
    d, _, t, p = _parts(spark, sf_dir)
    return g.anchor_shells(t, d.filter("label = 0").withColumn("aid", F.col("id")), p, [2.0, 4.0], 1.5)


@register("ge5_site_shape", v.with_sql(ATOMS, "c AS (SELECT structure, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM site GROUP BY 1)", "r AS (SELECT site.*, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM site JOIN c USING (structure))", "s AS (SELECT structure, count(*) AS n, avg(r) AS radius_mean, quantile_cont(r, 0.9) AS radius_p90, max(r) AS radius_max, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM r GROUP BY 1)",
    "w AS (SELECT *, 0.45 * greatest(0, least(1, (n - 12) / 24)) + 0.35 * greatest(0, least(1, (radius_p90 - 9) / 12)) + 0.20 * greatest(0, least(1, (ln(1 + volume) - 6) / 3)) AS overwide, 0 AS k FROM s)", select=select_sql("(SELECT *, 1 - overwide AS tightness FROM w)", "structure, n", "radius_mean, radius_p90, radius_max, volume, overwide, tightness")))
def ge5_site_shape(spark, sf_dir):
    return g.site_shape(_parts(spark, sf_dir)[1])


@register("ge6_site_centre", v.with_sql(ATOMS, "c AS (SELECT structure, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM site GROUP BY 1)", "pc AS (SELECT structure, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM partner GROUP BY 1)", "fc AS (SELECT structure, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM partner b WHERE EXISTS (SELECT 1 FROM site a WHERE a.structure = b.structure AND " + _D + " <= 1.5) GROUP BY 1)", "ne AS (SELECT a.structure, min(" + _D + ") AS nearest FROM c a JOIN partner b ON a.structure = b.structure GROUP BY 1)",
    "d1 AS (SELECT a.structure, " + _D + " AS to_partner FROM c a JOIN pc b ON a.structure = b.structure)", "d2 AS (SELECT a.structure, " + _D + " AS to_interface FROM c a JOIN fc b ON a.structure = b.structure)", select="SELECT c.structure, round(nearest, 6) AS nearest, round(to_partner, 6) AS to_partner, round(to_interface, 6) AS to_interface FROM c LEFT JOIN ne USING (structure) LEFT JOIN d1 USING (structure) LEFT JOIN d2 USING (structure)"))
def ge6_site_centre(spark, sf_dir):
    _, site, _, p = _parts(spark, sf_dir)
    return g.site_centre(site, p, 1.5)


@register("ge7_exposure", v.with_sql(ATOMS, "pr AS (SELECT a.structure, a.id, b.id AS oid, " + _D + " AS d FROM target a JOIN target b ON a.structure = b.structure AND a.id <> b.id WHERE " + _D + " <= 3.0)", "rk AS (SELECT *, row_number() OVER (PARTITION BY structure, id ORDER BY d, oid) AS r FROM pr)", "e AS (SELECT structure, id, count(*) AS n, avg(CASE WHEN r <= 5 THEN d END) AS knn FROM rk GROUP BY ALL)", select="SELECT t.structure, t.id, coalesce(n, 0) AS n_near, round(knn, 6) AS knn, round(0.55 * greatest(0, least(1, coalesce(knn, 3.0) / 3.0)) + 0.45 / (1 + 32 * coalesce(n, 0) / 27.0), 6) AS exposure FROM target t LEFT JOIN e ON e.structure = t.structure AND e.id = t.id"))
def ge7_exposure(spark, sf_dir):
    return g.exposure(_parts(spark, sf_dir)[2], 3.0, 5)


@register("ge15_annotate", v.with_sql(ATOMS, "n1 AS (SELECT structure, id, arg_min(o, (d, o)) AS nearest, min(d) AS dist FROM (SELECT a.structure, a.id, b.id AS o, " + _D + " AS d FROM atoms a JOIN atoms b ON a.structure = b.structure AND a.role <> b.role) GROUP BY ALL)", select="SELECT structure, id, role, nearest, round(dist, 6) AS dist, label IN (0, 1) AS in_site, coalesce(dist <= 1.5, FALSE) AS interface FROM atoms LEFT JOIN n1 USING (structure, id)"))
def ge15_annotate(spark, sf_dir):
    d, site, _, _ = _parts(spark, sf_dir)
    return g.annotate(d.select("structure", "id", "role", "x", "y", "z"), site, 1.5)


@register("ge16_contact_site", v.with_sql(ATOMS, "m AS (SELECT a.structure, a.id AS key, min(" + _D + ") AS dist FROM target a JOIN (SELECT * FROM partner WHERE label = 5) b ON a.structure = b.structure GROUP BY ALL)", select="SELECT structure, key, round(dist, 6) AS dist, cutoff FROM m, (SELECT unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS cutoff) WHERE dist <= cutoff"))
def ge16_contact_site(spark, sf_dir):
    _, _, t, p = _parts(spark, sf_dir)
    return g.contact_site(p.filter("label = 5").withColumn("lid", F.col("id")), t.withColumn("key", F.col("id")), [1.0, 2.0, 3.0])


@register("ag20_near_accuracy", v.with_sql(ATOMS, "t1 AS (SELECT structure, id, min(d) AS dist FROM (SELECT a.structure, a.id, " + _D + " AS d FROM site a JOIN (SELECT * FROM atoms WHERE label IN (1, 2)) b ON a.structure = b.structure) GROUP BY ALL)", "p1 AS (SELECT structure, id, min(d) AS dist FROM (SELECT a.structure, a.id, " + _D + " AS d FROM (SELECT * FROM atoms WHERE label IN (1, 2)) a JOIN site b ON a.structure = b.structure) GROUP BY ALL)",
    "a AS (SELECT structure, count(*) AS n_truth, avg(CASE WHEN dist <= 1.5 THEN 1.0 ELSE 0.0 END) AS near_coverage, avg(dist) AS mean_distance, median(dist) AS median_distance FROM t1 GROUP BY 1)", "b AS (SELECT structure, count(*) AS n_predicted, avg(CASE WHEN dist <= 1.5 THEN 1.0 ELSE 0.0 END) AS near_precision, avg(CASE WHEN dist > 0 THEN 1.0 ELSE 0.0 END) AS extra FROM p1 GROUP BY 1)",
    select=select_sql("(SELECT *, 0.45 * extra + 0.35 * (1 - near_precision) + 0.20 * greatest(0, least(1, (n_predicted / n_truth - 1) / 3)) AS overwide FROM a JOIN b USING (structure))", "structure, n_truth, n_predicted", "near_coverage, mean_distance, median_distance, near_precision, extra, overwide")))
def ag20_near_accuracy(spark, sf_dir):
    d, site, _, _ = _parts(spark, sf_dir)
    return g.near_accuracy(site, d.filter("label IN (1, 2)"), 1.5)


@register("ag28_split_roles", "WITH n AS (SELECT l_suppkey AS structure, CASE l_suppkey % 3 WHEN 0 THEN l_linestatus WHEN 1 THEN CASE WHEN l_linenumber >= 6 THEN 'S' ELSE l_returnflag END ELSE l_returnflag END AS chain, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY n, chain) AS r, count(*) OVER (PARTITION BY structure) AS c FROM n), m AS (SELECT structure, min(n) AS mn, max(CASE WHEN r = 2 THEN n END) AS sec FROM r GROUP BY 1) SELECT structure, chain, n, CASE WHEN NOT (c = 2 OR (c > 2 AND mn <= 2000 AND mn <= round(0.75 * sec))) THEN 'unknown' WHEN r = 1 THEN 'partner' ELSE 'target' END AS role FROM r JOIN m USING (structure)")
def ag28_split_roles(spark, sf_dir):
    """Chains of two, of three with a small one, and of three alike."""
    kind, flag = F.col("l_suppkey") % 3, F.col("l_returnflag")
    chain = F.when(kind == 0, F.col("l_linestatus")).when((kind == 1) & (F.col("l_linenumber") >= 6), "S").otherwise(flag)
    return g.split_roles(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure"), chain.alias("chain")), 2000)
