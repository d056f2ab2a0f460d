"""Corpus pipeline over ``documents``: language ID, toxicity, near-duplicates, packing.

Each stage works on all that its predecessor kept, is written as Parquet in the
shared folder and read again.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm.byte_cnn_lang import predict_language, train_language_model
from screenspark.llm.packing import pack_documents
from screenspark.llm.sampling import fresh
from screenspark.llm.simhash_dedup import similar_components
from screenspark.llm.toxicity import score_toxicity, train_toxicity
from screenspark.plans.staging import stage
from screenspark.plans.tables import table


#: A document stays if the network gives its language this probability at least, over all its windows.
LANGUAGE_FLOOR = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the network takes for a language that it learned, with LANGUAGE_FLOOR or more.

    Texts that are null or have no letter go.  Without any labelled document there is
    no network, and every text with a letter stays.
    """
    names = fresh(docs.columns, "held_out", "lang_pred", "lang_score")
    model = train_language_model(docs)
    if model is None:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    found = predict_language(docs, model, names)
    return found.filter((F.col(names[1]) != "und") & (F.col(names[2]) >= LANGUAGE_FLOOR)).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, learned from labels of documents still here, does not reject; null texts stay."""
    names = fresh(docs.columns, "held_out", "tox_score", "tox_pred")
    net = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, net, names).filter(F.col(names[2]) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 5-word shingles at similarity 0.8: that with the smallest doc_id (null last).

    Among rows of one id the smallest hash of the whole row decides, and of rows that
    are equal in every column one stays.
    """
    (row,) = fresh([*docs.columns, "doc_id", "text"], "row_hash")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    classes = similar_components(marked.select("doc_id", "text", F.col(row).alias("text_hash")), threshold=0.8, shingle=5)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    rows = classes.groupBy("component_key", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "copies")
    kept = stage(rows.groupBy("component_key").agg(F.min_by(first, order).alias("k")).select("k.*"), "kept")
    same = marked["doc_id"].eqNullSafe(kept["id"]) & (marked[row] == kept["hash"])
    single = marked.join(kept.filter("copies = 1"), same, "left_semi")
    repeated = marked.join(kept.filter("copies > 1"), same, "left_semi").dropDuplicates(["doc_id", row])
    return single.unionByName(repeated).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in windows of 4096 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", keep_languages), ("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates), ("packing", pack)]

#: Trained networks and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
