"""Recall of the search by inner product where norms and dimensions differ from the given tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm.mih_search import nearest_neighbours


@pytest.mark.parametrize(("n", "d", "sigma"), [(2000, 64, 0.5), (3000, 384, 0.0), (2000, 16, 1.0), (1500, 65, 0.0)])
def test_recall_on_unequal_norms_and_other_dimensions(spark, n, d, sigma):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    x *= (np.exp(sigma * rng.normal(size=n)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=20, shard_rows=1000).collect()
    hits = 0
    for q in range(0, n, 50):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        hits += len(best & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.97 * 20 * len(range(0, n, 50))


def test_ids_of_64_bits_beside_nulls_and_exact_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8))
    ids = [2**60 + 3 * i for i in range(57)] + [2**63 - 1, None, -(2**62) - 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    for recall in (0.95, 1.0):
        found = nearest_neighbours(df, F.lit(True), k=5, recall=recall, shard_rows=25, query_rows=20).collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert got.keys() == set(ids)
        for i, q in enumerate(ids):
            score = x @ x[i]
            order = [j for j in np.argsort(-score) if j != i][:5]
            if recall == 1.0 or i < 5:
                assert [got[q][n + 1][0] for n in range(5)] == [ids[j] for j in order]
            assert all(abs(s - float(x[ids.index(v)] @ x[i])) < 1e-12 for v, s in got[q].values())
