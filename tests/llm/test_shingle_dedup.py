"""The near-duplicate stage against brute force on near copies."""

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import drop_near_duplicates
from screenspark.llm import shingle_dedup, simhash_dedup


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies():
    rng = np.random.default_rng(4)
    line = [f"common{i}" for i in range(12)]
    texts = []
    for b in range(25):
        base = [f"w{x}" for x in rng.integers(0, 500, 60 + 4 * b)] + line
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"e{rng.integers(10_000)}"
            texts.append(" ".join(copy))
    return texts + ["one two", "one two", "One  TWO", "three"]


def classes(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "FREQUENT", 2)
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_stage_drops_near_copies_beyond_three_bits(spark):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark, df, "").collect())
    assert kept == sorted(set(classes(texts)))


def test_dense_lists_and_every_turn_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "DENSE", 2)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(60)]
    texts = []
    for _ in range(60):  # one dense group whose members are not all similar to each other
        copy = list(base)
        for at in rng.integers(0, 60, 3):
            copy[at] = f"e{rng.integers(40)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_shared_lists_over_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(h), int(k)) for h, k in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((r.h, r.key) for r in shingle_dedup.shared_lists(spark.createDataFrame(rows, "h long, key long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = {}
    for h, k in rows:
        keys.setdefault(h, set()).add(k)
    assert got == sorted((h, k) for h, ks in keys.items() if len(ks) > 1 for k in ks)


def test_stage_keeps_clashing_columns_and_one_of_equal_rows(spark):
    text = "one text of seven words for all"
    rows = [(2, text, "en", 7), (2, text, "en", 7), (2, text, "de", 8), (None, text, "fr", 9), (3, "another text with other words in it", "en", 1), (None, None, "en", 2), (None, "", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row_hash long")
    got = drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 3 and sum(r in [(2, text, "en", 7), (2, text, "de", 8)] for r in kept) == 1 and (3, "another text with other words in it", "en", 1) in kept


def test_stage_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert drop_near_duplicates(spark, df, "").count() == 0


def test_crowded_tries_are_split_again_and_again(spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(0xABCD_1234_0000_0000) + rng.integers(0, 1 << 18, 900).astype(np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    assert {r["depth"] for r in simhash_dedup.node_pairs(nodes, 3, 8).select("depth").distinct().collect()} >= {16, 48}
    links = simhash_dedup.fingerprint_links(nodes, 3, leaves=8)
    from screenspark.llm.components import Forest

    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got, want = Forest(len(fps)), Forest(len(fps))
    e = links.collect()
    got.link(np.array([place[r.u] for r in e]), np.array([place[r.v] for r in e]))
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 3
    want.link(i[near], j[near])
    assert (got.label == want.label).all()


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for share in (0.0, 0.5, 0.9, 1.0):
        other = np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 2**63, 200).astype(np.uint64)]))
        x, y = (shingle_dedup.parities(s).view(np.uint64) for s in (base, other))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(np.setxor1d(base, other)) and (differ > 60 or share > 0.5)
    assert not shingle_dedup.parities(base[:0]).any()
