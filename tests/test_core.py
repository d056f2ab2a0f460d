"""Operators against hand rows: NULLs, ties, empty tables, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from screenspark.functions import columns as c
from screenspark.operators import consensus, decisions, metrics, quality, residues, scoring, spatial


def one(df):
    return df.collect()[0]


def test_clean_and_finite(spark):
    d = spark.createDataFrame([(" NaN ", "nan"), ("x", "1.5"), (None, "inf"), ("n/a", "abc")], "a string, b string")
    rows = d.select(c.clean_text("a").alias("a"), c.finite("b").alias("b"), c.finite("b", 0.0).alias("z")).collect()
    assert [r.a for r in rows] == ["", "x", "", ""] and [r.b for r in rows] == [None, 1.5, None, None] and [r.z for r in rows] == [0.0, 1.5, 0.0, 0.0]


def test_clip_keeps_null(spark):
    d = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r.y for r in d.select(c.clip("x", 0, 1).alias("y")).collect()] == [None, 0.0, 1.0]


def test_robust_scale_constant_null_and_empty(spark):
    d = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, 7.0), (1.0, None, None)], "a double, b double, c double")
    rows = scoring.robust_scale(d, ["a", "b", "c"]).orderBy(F.col("c").asc_nulls_last()).collect()
    assert [r.s_a for r in rows] == [0.5] * 3 and [r.s_b for r in rows] == [None] * 3 and rows[0].s_c == 0 and rows[1].s_c == 1 and rows[2].s_c is None
    assert scoring.robust_scale(d.limit(0), ["a"]).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "candidate long, variant string, item string, site_hit_fraction double, energy_gb double, rule_score double, status string")


def test_topk_uses_energy_only_where_a_group_has_it(spark):
    d = items(spark, [(1, "a", "x", 0.1, None, 0.9, "ok"), (1, "a", "y", 0.1, -5.0, 0.1, "ok"), (1, "a", "z", 0.1, -9.0, 0.2, "ok"), (1, "b", "p", 0.1, None, 0.3, "ok"), (1, "b", "q", 0.1, None, 0.8, "ok")])
    got = {(r.variant, r.topk_position): (r.item, r.selection_mode) for r in scoring.select_topk(d, 2).collect()}
    assert got == {("a", 1): ("z", "energy_asc"), ("a", 2): ("y", "energy_asc"), ("b", 1): ("q", "score_desc"), ("b", 2): ("p", "score_desc")}


def test_keep_ok_keeps_all_if_none_is_ok(spark):
    d = items(spark, [(1, "a", "x", 0.1, None, 0.9, "failed"), (1, "a", "y", 0.1, None, 0.9, "failed")])
    assert scoring.keep_ok(d).count() == 2 and scoring.keep_ok(d.unionByName(d.limit(1).withColumn("status", F.lit("ok")))).count() == 1
    assert scoring.keep_ok(d.limit(0)).count() == 0


def test_rank_candidates_is_independent_of_partitions(spark):
    rng = random.Random(1)
    rows = [(i % 5, "ab"[i % 2], f"i{i}", rng.random(), rng.random() if i % 3 else None, None, "ok") for i in range(90)]
    d = items(spark, rows).drop("rule_score")
    a, b = (scoring.rank_candidates(x).orderBy("rank").collect() for x in (d.repartition(1), d.repartition(7)))
    assert [r.candidate for r in a] == [r.candidate for r in b] and [r["rank"] for r in a] == [1, 2, 3, 4, 5]
    assert all(abs(x.final_score - y.final_score) < 1e-12 for x, y in zip(a, b, strict=True))


def test_auc_shares_ties_and_needs_both_classes(spark):
    d = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1), (None, 0.3), (1.0, None)], "y double, s double")
    assert one(metrics.auc(d, "y", "s")).auc == pytest.approx(0.875)
    assert one(metrics.auc(d.filter("y = 1"), "y", "s")).auc is None


def test_pearson_without_variance_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    r = one(metrics.pearson(d, "x", "y"))
    assert r.pearson is None and r.n == 2


def test_reliability_closes_the_last_bin(spark):
    d = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "y double, s double")
    rows = metrics.reliability(d, "y", "s", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 1]


def test_grid_join_equals_all_pairs_and_has_no_cross_product(spark):
    rng = random.Random(2)
    pts = [(i % 3, i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(150)]
    a = spark.createDataFrame(pts[:80], "structure long, id long, x double, y double, z double")
    b = spark.createDataFrame(pts[80:], "structure long, pid long, x double, y double, z double")
    got = spatial.distance_join(a, b, 3.0, ["id"], ["pid"])
    want = {(p[1], q[1]) for p in pts[:80] for q in pts[80:] if p[0] == q[0] and sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)) <= 9}
    assert {(r.id, r.pid) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    near = {r.id: r.pid for r in spatial.nearest_join(a, b, "id", "pid", 1.0).collect()}
    assert near == {p[1]: min((sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)), q[1]) for q in pts[80:] if q[0] == p[0])[1] for p in pts[:80]}


def test_toy_complex(spark):
    site = spark.createDataFrame([(1, "A:20", 0.0, 0.0, 0.0), (1, "A:30", 0.0, 8.0, 0.0)], "structure long, id string, x double, y double, z double")
    partner = spark.createDataFrame([(1, "H:101", 0.0, 0.0, 3.5), (1, "H:102", 15.0, 0.0, 0.0)], "structure long, pid string, x double, y double, z double")
    r = one(spatial.site_contact(site, partner, 4.5))
    assert r.n_hit == 1 and r.n_site == 2 and r.min_distance == 3.5
    assert {x.id: round(x.dist, 4) for x in spatial.nearest_join(site, partner, "id", "pid").collect()} == {"A:20": 3.5, "A:30": 8.7321}


def test_residue_match_rules(spark):
    keys = spark.createDataFrame([(1, k) for k in ("A:10", "A:20", "A:31", ":40", "Z:40", "B:55", "A:99", "A:61")], "structure long, key string")
    res = spark.createDataFrame([(1, k) for k in ("A:10", "A:20:X", "A:30", "A:32", "B:40", "A:60:P", "A:60:Q", "A:62")], "structure long, key string")
    got = {r.key: (r.matched_key, r.mode) for r in residues.match_residues(keys, res).collect()}
    z = got.pop("Z:40")
    assert z == ("B:40", "any_chain_icode") and got.pop(":40") == ("B:40", "any_chain_icode")
    assert got == {"A:10": ("A:10", "exact"), "A:20": ("A:20:X", "chain_number"), "A:31": ("A:30", "offset_-1"), "B:55": (None, "unmatched"), "A:99": (None, "unmatched"), "A:61": ("A:62", "offset_+1")}


def test_greedy_diversity_has_a_closed_form(spark):
    rng = random.Random(5)
    for _ in range(5):
        rows = [(i, rng.choice(decisions.TIERS), rng.choice("abc"), round(rng.random(), 3), i + 1) for i in range(25)]
        d = spark.createDataFrame(rows, "candidate long, tier string, diversity_group string, priority_score double, consensus_rank int")
        got = [r.candidate for r in decisions.diversify(d).orderBy("suggestion_rank").collect()]
        seen, want = {}, []
        for tier in decisions.TIERS:
            left = [r for r in rows if r[1] == tier]
            while left:
                def value(r):
                    s = seen.get(r[2], 0)
                    return (-round(r[3] - (0.08 * s + (0.08 * (s - 1) if s >= 2 else 0)), 9), -r[3], r[4])
                best = min(left, key=value)
                left.remove(best)
                seen[best[2]] = seen.get(best[2], 0) + 1
                want.append(best[0])
        assert got == want


def test_plan_respects_budgets(spark):
    rows = [(1, i, "validate_now" if i < 5 else "backup", "g" if i % 2 else "h", i + 1) for i in range(12)]
    d = spark.createDataFrame(rows, "batch long, candidate long, tier string, diversity_group string, suggestion_rank int")
    over = spark.createDataFrame([(11, "include", ""), (0, "exclude", "")], "candidate long, override string, status string")
    got = {r.candidate: r.plan for r in decisions.plan(d, 4, {"validate_now": 2, "backup": 2}, 3, over).collect()}
    assert got[11] == "include" and got[0] == "excluded" and sum(p == "include" for p in got.values()) == 4 and sum(p == "standby" for p in got.values()) == 3


def test_numeric_labels_between_the_classes_are_neither(spark):
    d = spark.createDataFrame([("0", "", ""), ("0.3", "", ""), ("0.5", "", ""), ("", "Hit", ""), ("", "", "completed"), ("", "", "")], "validation_label string, result string, status string")
    rows = decisions.infer_validation(d).collect()
    assert [r.inferred_label for r in rows] == [0, None, 1, 1, None, None] and [r.category for r in rows][4:] == ["completed_without_result", "no_evidence"]


def test_near_ties_and_gaps(spark):
    d = spark.createDataFrame([(1, 0.90, 1), (2, 0.87, 2), (3, 0.50, 3)], "candidate long, consensus_score double, consensus_rank int")
    rows = {r.candidate: r for r in consensus.score_gaps(d).collect()}
    assert rows[1].near_ties == 1 and rows[2].near_ties == 1 and rows[3].near_ties == 0 and rows[1].close_competition and not rows[3].close_competition


def test_any_warning_row_makes_the_gate_warn(spark):
    d = spark.createDataFrame([("ok", True, 0.5, 0.1, 1.0), ("ok", False, 0.5, 0.1, 0.0)], "status string, has_warning boolean, f double, overwide double, label double")
    got = {r.check: r.status for r in quality.quality_gate(d, "f", "overwide", "label").collect()}
    assert got["warning_rows"] == "WARN" and got["failed_rows"] == "PASS"
    assert {r.check: r.status for r in quality.quality_gate(d.limit(0), "f", "overwide", "label").collect()}["row_count"] == "FAIL"


def test_flagship_scans_its_staged_rows_twice_at_most(spark):
    """The items are staged once; the ranking reads them for the top rows and for the sizes."""
    from screenspark.operators import scoring

    items = spark.range(600).select((F.col("id") % 5).alias("candidate"), (F.col("id") % 3).cast("string").alias("variant"), F.col("id").cast("string").alias("item"), (F.col("id") % 50).cast("double").alias("site_hit_fraction"), (F.col("id") * 7 % 90).cast("double").alias("energy_gb"), F.lit("ok").alias("status"))
    ranked = scoring.rank_candidates(items)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and "Join Inner" in plan and "Cross" not in plan
    assert ranked.count() == 5


def test_quantiles_in_brackets_equal_those_of_all_values(spark):
    from screenspark.operators.quantiles import exact_quantiles

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") % 3 == 1, F.col("id") / 7).alias("b"), F.lit(None).cast("double").alias("c"))
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    whole = exact_quantiles(df, ["a", "b", "c"], probs)
    parts = exact_quantiles(df, ["a", "b", "c"], probs, held=40, accuracy=200)
    assert whole["c"] == parts["c"] == [None] * 6
    for c in "ab":
        assert all(abs(x - y) < 1e-9 for x, y in zip(whole[c], parts[c], strict=True))


def test_running_counts_by_slices_equal_plain_ranks(spark):
    from screenspark.operators import metrics

    df = spark.range(900).select((F.col("id") % 2).alias("g"), (F.col("id") * 31 % 101).cast("double").alias("v"))
    rows = metrics.avg_rank(df, "v", "r", ["g"]).collect()
    for g in (0, 1):
        values = sorted(r.v for r in rows if r.g == g)
        for r in rows:
            if r.g == g:
                low, high = values.index(r.v) + 1, len(values) - values[::-1].index(r.v)
                assert r.r == (low + high) / 2


def test_nearest_by_rings_equals_all_pairs(spark):
    import itertools

    from screenspark.operators.spatial import nearest_join

    a = [(i % 3, i, float(i * 37 % 100), float(i * 11 % 60), 0.0) for i in range(40)]
    b = [(i % 2, 1000 + i, float(i * 53 % 90), float(i * 29 % 70), 5.0) for i in range(12)]
    found = nearest_join(spark.createDataFrame(a, "structure int, id int, x double, y double, z double"), spark.createDataFrame(b, "structure int, pid int, x double, y double, z double"), "id", "pid")
    want = {}
    for p, q in itertools.product(a, b):
        if p[0] == q[0]:
            d = sum((u - w) ** 2 for u, w in zip(p[2:], q[2:], strict=True)) ** 0.5
            want[p[1]] = min(want.get(p[1], (9e9, 0)), (d, q[1]))
    assert {r.id: (round(r.dist, 9), r.pid) for r in found.collect()} == {k: (round(d, 9), pid) for k, (d, pid) in want.items()}


def jobs_of(spark, fn):
    """How many Spark jobs ``fn`` runs, and what it returns."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_quantiles_take_as_many_jobs_for_many_columns(spark):
    from screenspark.operators.quantiles import exact_quantiles

    df = spark.range(3000).select(*((F.col("id") * (7919 + 2 * i) % 3001).cast("double").alias(f"c{i}") for i in range(12))).cache()
    df.count()
    few, one_column = jobs_of(spark, lambda: exact_quantiles(df, ["c0"], [0.5], accuracy=300))
    many, all_columns = jobs_of(spark, lambda: exact_quantiles(df, df.columns, [0.01, 0.5, 0.99], accuracy=300))
    assert few == many <= 6 and all_columns["c0"][1] == one_column["c0"][0]


def test_quantiles_among_ties_and_narrow_brackets(spark):
    import numpy as np

    from screenspark.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(5)
    cols = {"half": np.r_[np.zeros(500), np.ones(500)], "few": rng.integers(0, 5, 1000).astype(float), "long": rng.lognormal(size=1000), "same": np.full(1000, 7.0)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in cols.values()))), list(cols)).repartition(5)
    probs = [0.0, 0.25, 0.4995, 0.5, 0.5005, 0.75, 1.0]
    for held, accuracy in ((500_000, 20_000), (3, 50), (0, 20)):
        got = exact_quantiles(df, list(cols), probs, held, accuracy)
        for c, v in cols.items():
            assert np.allclose(got[c], np.quantile(v, probs)), (c, held)


def test_kendall_equals_all_pairs(spark):
    import numpy as np

    from screenspark.operators import metrics

    rng = np.random.default_rng(3)
    for n, values, rows in ((120, 1000, 10), (150, 4, 3), (200, 12, 20), (1, 5, 10), (90, 1, 10)):
        x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
        x[: n // 3] = x[0]  # a third of the rows share a value
        s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        want = s.sum() / (s != 0).sum() if (s != 0).any() else None
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(n, None, 1.0)], "k int, x double, y double")
        got = metrics.kendall(df, "k", "x", "y", slice_rows=rows).collect()[0].kendall
        assert got == want if want is None else abs(got - want) < 1e-12
    big = np.array([3 * 10**9, 5 * 10**9])
    assert metrics.inversions(np.array([2.0, 1.0]), big) == 15 * 10**18


def test_path_repair_rules(spark):
    from screenspark.operators import quality

    files = ["x/a/one.pdb", "x/a/two.pdb", "x/b/two.pdb", "x/a/three.pdb", "y/a/three.pdb", "x/q/four.pdb", "y/r/four.pdb", "x/five.cif", "x/six.cif", "y/six.txt", "x/here.pdb"]
    refs = ["old/one.pdb", "Old/B/TWO.pdb", "x/z/two.pdb", "old/a/three.pdb", "old/four.pdb", "old/five.pdb", "old/six.pdb", "old/none.pdb", "x/here.pdb", "old/one.pdb"]
    made = quality.plan_path_repair(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(f,) for f in files], "path string"))
    got = {r.ref: (r.path, r.confidence, r.candidates, r.auto) for r in made.collect()}
    assert got == {
        "old/one.pdb": ("x/a/one.pdb", 0.96, 1, True), "Old/B/TWO.pdb": ("x/b/two.pdb", 0.90, 2, True), "x/z/two.pdb": ("x/a/two.pdb", 0.58, 2, False), "old/a/three.pdb": ("x/a/three.pdb", 0.58, 2, False),
        "old/four.pdb": ("x/q/four.pdb", 0.58, 2, False), "old/five.pdb": ("x/five.cif", 0.72, 1, True), "old/six.pdb": ("x/six.cif", 0.45, 2, False),
    }
