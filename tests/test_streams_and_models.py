"""Streams against batch, folds and models."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from screenspark.operators import metrics, model
from screenspark.plans.staging import new_path
from screenspark.streaming import ledger


def events(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 4, t0 + dt.timedelta(hours=h), "s%d" % i, i % 3, i % 5 == 0) for i, h in enumerate([0, 5, 3, 30, 29, 31, 50, 2, 70, 71])]
    d = spark.createDataFrame([*rows, rows[3]], "event_id long, candidate long, ts timestamp, status string, source_priority int, has_warning boolean")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    return d.dropDuplicates(["event_id"]), spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))


def test_final_state_of_the_stream_is_that_of_the_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = ledger.latest_of_slices(ledger.run_updates(ledger.stream_ledger(stream, delay="30 days"), str(tmp_path / "o"), str(tmp_path / "c"), ["slice_start", "candidate"]))
    want = batch.groupBy("candidate").agg(F.max_by("status", F.struct("ts", -F.col("source_priority"), "event_id")).alias("status"), F.count("*").alias("n"))
    assert {(r.candidate, r.status, r.n_records) for r in got.collect()} == {(r.candidate, r.status, r.n) for r in want.collect()}


def test_windows_and_sessions(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    qc = ledger.run_updates(ledger.stream_qc(stream.dropDuplicates(["event_id"]), "1 day", delay="30 days"), str(tmp_path / "o1"), str(tmp_path / "c1"), ["window_start"])
    assert sorted(r.n_rows for r in qc.collect()) == [3, 3, 4]
    s = ledger.run_sessions(stream, "6 hours", str(tmp_path / "o2"), str(tmp_path / "c2"), delay="30 days")
    assert sum(r.n_events for r in s.collect()) == batch.count() + 1 and not any(r.closed for r in s.collect())


def test_state_falls_as_the_watermark_moves_and_sessions_close_once(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    days = [(d, [(100 * d + i, i % 7, t0 + dt.timedelta(days=d, minutes=9 * i), f"s{d}", i % 3, False) for i in range(70)]) for d in (0, 4, 8, 12)]
    schema = "event_id long, candidate long, ts timestamp, status string, source_priority int, has_warning boolean"
    for _, rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    slices = ledger.run_updates(ledger.stream_ledger(stream, delay="1 day"), str(tmp_path / "o"), str(tmp_path / "c"), ["slice_start", "candidate"])
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in")).groupBy("candidate").agg(F.max_by("status", F.struct("ts", -F.col("source_priority"), "event_id")).alias("status"), F.count("*").alias("n"))
    assert {(r.candidate, r.status, r.n_records) for r in ledger.latest_of_slices(slices).collect()} == {(r.candidate, r.status, r.n) for r in batch.collect()}
    assert slices.count() == 4 * 7 and max(slices.state_rows) <= 2 * 70 and slices.state_rows[-1] <= 70  # of 280 events and 28 slices
    sessions = ledger.run_sessions(stream, "3 hours", str(tmp_path / "o2"), str(tmp_path / "c2"), delay="1 day")
    rows = sessions.collect()
    assert len(rows) == 4 * 7 and all(r.n_events == 10 for r in rows) and {(r.session_start.day, r.closed) for r in rows} == {(1, True), (5, True), (9, True), (13, False)}


def test_append_mode_emits_only_closed_windows(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    out = ledger.run_to_parquet(ledger.stream_qc(stream, "1 day", delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    assert {r.window_start.day for r in out} == {1, 2}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    day = lambda d, n, i: spark.createDataFrame([(i + k, dt.datetime(2024, 1, d, k), "ok", False) for k in range(n)], "event_id long, ts timestamp, status string, has_warning boolean").coalesce(1)
    for i, (d, n) in enumerate([(1, 4), (5, 3), (6, 2), (1, 2), (9, 1)]):  # the fourth file comes two batches after its day is closed
        day(d, n, 10 * i).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ledger.run_to_parquet(ledger.stream_qc(stream, "1 day", delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r.window_start.day: r.n_rows for r in out.collect()} == {1: 4, 5: 3, 6: 2}
    assert out.late_rows >= 1  # counted by groups that are combined before the state


def rows(spark):
    data = [(i % 6, "ab"[i % 2], f"i{i}", (i * 37 % 100) / 100, None if i % 9 == 0 else (i * 17 % 50) / 50, float((i * 37 % 100) > 50)) for i in range(180)]
    return spark.createDataFrame(data, "candidate long, variant string, item string, site_hit_fraction double, mouth_occlusion double, label double")


def test_folds_and_split_keep_candidates_together(spark):
    d = rows(spark)
    folds = metrics.group_folds(d, 3).collect()
    assert len(folds) == 6 and sorted(r.fold for r in folds) == [0, 0, 1, 1, 2, 2]
    sides = [r.side for r in metrics.group_split(d, 0.3).collect()]
    assert sides.count("validation") == 2 and len(sides) == 6
    assert [r.side for r in metrics.group_split(d.filter("candidate < 2"), 0.0).collect()].count("validation") == 1


def test_model_ranks_better_than_chance_and_fills_missing_values(spark):
    d, cols = rows(spark), ["site_hit_fraction", "mouth_occlusion"]
    fitted = model.fit_prep(d, cols)
    prepared = model.apply_prep(d, fitted, cols)
    assert prepared.filter("z_mouth_occlusion IS NULL").count() == 0
    p = model.predict(model.train(prepared, cols), prepared, cols)
    assert metrics.auc(p, "label", "pred_prob").collect()[0].auc > 0.95
    assert p.filter("top_contributions = ''").count() == 0


def test_pseudo_labels_share(spark):
    d = rows(spark).withColumn("site_hit_fraction", F.col("site_hit_fraction") + F.regexp_extract("item", r"(\d+)", 1).cast("double") / 1e6)
    share = model.pseudo_labels(d, "top_fraction", 0.3).agg(F.avg("pseudo_label")).collect()[0][0]
    assert 0.25 <= share <= 0.35
    assert model.pseudo_labels(d, "fixed", 2.0).filter("pseudo_label = 1").count() == 0


def test_shared_folder_is_one_for_the_session(spark):
    assert new_path(spark, "a").rsplit("/", 1)[0] == new_path(spark, "b").rsplit("/", 1)[0]


def test_weighted_network_equals_repeated_rows(spark):
    import numpy as np

    from screenspark.operators import network

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y, w = (x[:, 0] * x[:, 1] > 0).astype(float), rng.integers(0, 4, 60)
    rows = [(v.tolist(), float(a), float(b)) for v, a, b in zip(x, y, w, strict=True)]
    schema = "x array<double>, y double, w double"
    once, repeated = spark.createDataFrame(rows, schema), spark.createDataFrame([(v, a, 1.0) for v, a, b in rows for _ in range(int(b))], schema)
    net = network.Network.drawn([3, 5, 4, 1], 1)
    one, two = network.weighted_sums(once, net), network.weighted_sums(repeated.repartition(3), net)
    assert np.allclose(one, two)
    values, step = net.flat(), 1e-6  # the gradient is that of the loss
    for i in (0, 17, len(values) - 1):
        ends = [net.filled(values + s * step * np.eye(len(values))[i]).loss_and_gradient(x, y, w.astype(float))[0] for s in (1, -1)]
        assert abs((ends[0] - ends[1]) / (2 * step) - one[2 + i]) < 1e-4
    trained = network.train_network(once, 3, steps=80)
    assert network.weighted_sums(once, trained)[0] < 0.3 * one[0]


def test_perceptron_ranks_and_predicts(spark):
    d, cols = rows(spark), ["site_hit_fraction", "mouth_occlusion"]
    prepared = model.apply_prep(d, model.fit_prep(d, cols), cols)
    p = model.predict(model.train(prepared, cols, kind="perceptron"), prepared, cols)
    assert p.columns == [*prepared.columns, "pred_prob"] and metrics.auc(p, "label", "pred_prob").collect()[0].auc > 0.95


def test_folds_share_their_passes(spark, monkeypatch):
    """Quantiles of the rows take the same passes for any number of folds, and are those of each fold by itself."""
    from screenspark.operators import model, quantiles
    from screenspark.plans import views

    asked = []

    def counted(df, cols, *more):
        asked.append(cols)
        return quantiles.exact_quantiles(df, cols, *more)

    d = views.items(spark, "/root/testdata/sf0.001").selectExpr("*", "cast(candidate % 2 as int) AS fold").select("fold", "mouth_occlusion", "site_distance").localCheckpoint()
    cols = ["mouth_occlusion", "site_distance"]
    monkeypatch.setattr(model, "exact_quantiles", counted)
    fitted = [row.first() for row in model.fit_folds(d, cols, 2)]
    assert len(asked) == 1
    monkeypatch.undo()
    for fold in range(2):
        assert fitted[fold].asDict() == pytest.approx(model.fit_prep(d.filter(f"fold <> {fold}"), cols).first().asDict(), rel=1e-12)
        assert model.fold_quantiles(d, [(False, cols)], [0.01, 0.99], 2)[0][fold] == quantiles.exact_quantiles(d.filter(f"fold = {fold}"), cols, [0.01, 0.99])
