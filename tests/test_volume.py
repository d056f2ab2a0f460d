"""Work that must not grow with rows that are equal, and listings that must not pass through the driver."""

import os

import pytest
from pyspark.sql import functions as F

from screenspark.operators import search
from screenspark.sources import structures as s


def test_equal_rows_meet_trials_once(spark, monkeypatch):
    met, sweep = [], search.sweep

    def look(df, grid):
        met.append(df.count())
        return sweep(df, grid)

    monkeypatch.setattr(search, "sweep", look)
    rows = [(float(i % 2), float(i % 3), None if i % 3 == 2 else float(i % 5)) for i in range(300)]
    d = spark.createDataFrame(rows, "y double, a double, b double")
    got = {r.trial: r for r in search.weight_trials(d, {"a": 1, "b": -1}, [(0, 0.5, 0.5), (1, 1.0, 0.0)], "y").collect()}
    assert met == [22] and (got[0].n_pos, got[0].n_neg) == (150, 150)
    assert got[1].auc == 0.5


def test_line_files_are_written_without_a_commit_of_folders(spark):
    from screenspark.plans.queries_readers import file_of, written

    rows = [("a", 2, "x 7"), ("a", 1, "y 1.5 -2.5e1"), ("b", 1, None), ("b", 2, "no number"), ("c", 5, "z .5 t"), ("c", 9, "-")]
    path = written(spark.createDataFrame(rows, "file string, line_no int, line string"), "volume").removeprefix("file://")
    assert sorted(os.listdir(path)) == ["file=a", "file=b", "file=c"]
    back = s.read_lines(spark, path).withColumn("file", file_of())
    assert sorted((r.file, r.line) for r in back.collect()) == sorted([(f, t or "") for f, _, t in rows] + [(f, "") for f in "abc"])
    assert {r.file: r.value for r in s.last_float(back).collect()} == {"a": 7.0, "c": 0.5}


def test_occupancy_sql_takes_the_points_that_the_operator_takes(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from screenspark.plans import registry

    rows = [(5 * i, 9 if i % 50 == 0 else i % 2, [((i * k) % 997) / 997 - 0.5 for k in (37, 101, 211)]) for i in range(1, 1300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in registry.QUERIES["ge11_site_occupancy"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got[0][1] == 4096
    assert got == con.execute(registry.SQL["ge11_site_occupancy"]).fetchall()


def test_trees_are_listed_by_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    names = ["c1/t_1/p1/p1.pdb", "c1/t_1/p1/e.txt", "c1/t_1/p1/_tmp/x/p.pdb", "c1/.git/p2/p2.pdb", "c1/t_1/p3/deep/er/than/a/tree.txt", "c=_2/t_1/p4/P4.PDB", "top.txt"]
    s.write_files(spark.createDataFrame([(n, "ATOM") for n in names] + [("c1/t_1/p1/void.txt", None)], "path string, content string"), root)
    d = s.list_files(spark, root)
    assert sorted((r.path.removeprefix(f"{root}/"), r.size) for r in d.collect()) == sorted((names[i], 4) for i in (0, 1, 4, 5, 6))
    for e in (*s.read_tree(spark, root, "t"), s.read_tree_atoms(spark, root, "t")):
        assert "FileScan" not in e._jdf.queryExecution().executedPlan().toString()


def test_ranked_items_of_a_candidate_are_staged_together(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    from screenspark.plans import views

    d = views.ranked_items(spark, folder, "label")
    assert d.columns == [*views.RANKED, "label"]
    assert d.count() == views.items(spark, folder).count()
    assert d.select("candidate", F.input_file_name().alias("file")).distinct().count() == d.select("candidate").distinct().count()


def test_soft_targets_stage_only_what_is_trained_on(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    from screenspark.plans import queries_model as q

    seen, stage = [], q.stage
    monkeypatch.setattr(q, "stage", lambda d, tag: seen.append(d.columns) or stage(d, tag))
    assert q.ml4_soft_targets(spark, folder).count() > 0
    assert seen == [["item", *q.COLS, "pseudo_score"]]
