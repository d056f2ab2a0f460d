"""Whitening against a dense solver."""

import math

import numpy as np
import pytest

from screenspark.llm import whitening as wh


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((x * n - s) ** 2).sum(axis=1), c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_equals_dense_solver(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 24)) * np.linspace(0.2, 2, 24)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i if i != 3 else None, v, i, i) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n long, component long").repartition(3)
    rows = wh.whiten(df).collect()
    deviation, white, explained = brute(x)
    assert len(rows) == 400 * 8
    at = {(3 if r.vec_id is None else r.vec_id, r.component): r for r in rows}
    got = np.array([[at[i, c].whitened for c in range(1, 9)] for i in range(400)])
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert all(at[i, c].deviation == deviation[i] and at[i, c].n == 400 for i in range(400) for c in (1, 8))
    assert np.allclose([at[0, c].explained for c in range(1, 9)], explained, rtol=1e-10)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10


@pytest.mark.parametrize(("d", "spread"), [(3, "steps"), (60, "near"), (150, "near"), (150, "steps"), (90, "equal")])
def test_eigenpairs_to_double_precision(d, spread):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = {"steps": 1.0 / np.arange(1, d + 1) ** 2, "near": 1 + 0.1 * rng.random(d), "equal": np.where(np.arange(d) < 10, 1.0, 0.0)}[spread]
    v = turn * values @ turn.T
    v = (v + v.T) / 2
    calls = []
    found, axes = wh.largest_eigenpairs(lambda q: calls.append(1) or v @ q, d, 8)
    k = len(found)
    assert k == min(8, d) and np.allclose(found, np.sort(values)[::-1][:k], rtol=1e-12, atol=1e-13)
    assert np.abs(v @ axes - axes * found).max() < 1e-13 and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
    assert len(calls) < 400


def test_edge_rows(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, []), (6, [1e300, 0.0])]
    schema = "vec_id long, embedding array<double>"
    assert wh.whiten(spark.createDataFrame(bad, schema)).collect() == []
    assert wh.whiten(spark.createDataFrame([], schema)).collect() == []
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)
    assert wh.whiten(equal).collect() == []
    rows = wh.whiten(spark.createDataFrame([*bad, (7, [0.0, 0.0]), (7, [0.0, 0.0]), (8, [4.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [2.0, 2.0, 9.0])], schema)).collect()
    # Each length is a list of its own, and a direction without spread has no component.
    assert sorted((r.vec_id, r.component, r.n) for r in rows) == [(7, 1, 3), (7, 1, 3), (8, 1, 3), (9, 1, 2), (10, 1, 2)]
    assert {r.vec_id: r.deviation for r in rows} == {7: 4096**2, 8: 8192**2, 9: 1024**2 + 6144**2, 10: 1024**2 + 6144**2}
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in rows)


def test_exact_beyond_64_bits(spark):
    big = 2.0**40
    rows = wh.whiten(spark.createDataFrame([(i, [big * (i % 3), float(i)]) for i in range(2100)], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 2100  # the second direction is nothing beside the first
    x = np.array([[int(1024 * big * (i % 3)) + 100_000, 1024 * i + 100_000] for i in range(2100)], object)
    s = x.sum(axis=0)
    want = [int(((v * 2100 - s) ** 2).sum()) for v in x]
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in rows)
