"""The pipeline's stages: what they keep, clashing columns, tables without labels, and the whole run."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
EN, DE = "the house of our old friends is near the river and they like it".split(), "das haus der alten freunde steht nahe am fluss und sie mögen es sehr".split()


def texts(n=120, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE, 30)), "en" if i % 2 else "de") for i in range(n)]


def test_language_stage(spark):
    rows = [(*r, f"p{r[0]}", 7.0) for r in texts()] + [(900, None, "en", "x", 1.0), (901, "12 34 !!", "en", "x", 1.0), (902, "", None, "x", 1.0), (None, " ".join(EN), None, "null id", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Held_Out double")
    kept = corpus_pipeline.keep_languages(spark, df, "")
    assert kept.columns == df.columns
    got = {tuple(r) for r in kept.collect()}
    assert got == {r for r in rows if r[0] not in (900, 901, 902)}
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_languages(spark, bare, "").count() == 121
    assert corpus_pipeline.keep_languages(spark, df.limit(0), "").count() == 0


def test_toxicity_stage(spark, tmp_path):
    rows = [(i, t + (" vileword" if i % 3 == 0 else ""), i) for i, t, _ in texts(150)] + [(None, None, -1), (500, "", -2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tox_score int")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    got = {tuple(r) for r in kept.collect()}
    assert got == {r for r in rows if r[0] is None or r[0] == 500 or r[0] % 3}
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, df, str(tmp_path / "none")).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")
def test_whole_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    pieces = out.collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {p.doc_id for p in pieces} <= set(docs) and len({p.doc_id for p in pieces}) > len(docs) / 2
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    for parts in by_doc.values():
        parts.sort()
        assert [s for s, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
    kept = [docs[d].text for d in by_doc]
    assert len({" ".join(t.lower().split()) for t in kept}) == len(kept)  # no exact copies are left
