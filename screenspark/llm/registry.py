"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm.byte_cnn_lang import predict_language, train_language_model
from screenspark.llm.chat_events import conversation_digests, written_conversations
from screenspark.llm.mih_search import nearest_neighbours
from screenspark.llm.order_minhash import edited_fingerprints
from screenspark.llm.packing import pack_documents
from screenspark.llm.piece_nbest import segment_texts
from screenspark.llm.pivot_dedup import embedding_components
from screenspark.llm.seekable_tokens import read_token_files, write_token_files
from screenspark.llm.simhash_dedup import simhash_components
from screenspark.llm.source_divergence import SQL as DIVERGENCE_SQL
from screenspark.llm.source_divergence import source_divergence
from screenspark.llm.token_counts import token_counts
from screenspark.llm.toxicity import score_toxicity, train_toxicity
from screenspark.llm.whitening import whiten
from screenspark.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {"op12_source_divergence": DIVERGENCE_SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", window=4096, end_id=2)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to seekable token files and read back."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)
    return read_token_files(manifest, with_ids=False)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"), max_bits=3, shingle=3).select("doc_id", "fingerprint", "component_id")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, from the rendered output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversation_digests(written_conversations(rows.unionByName(hard)))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at cosine 0.95."""
    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op7_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best segmentations of all documents, as scores and checksums; the best is the library's encoding."""
    return segment_texts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", n=4, with_ids=False)


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all embeddings."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a network learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", F.col("tox_score").alias("score"), F.col("tox_pred").alias("predicted"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a network learned from languages that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs.select("doc_id", "text"), train_language_model(docs))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query
def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents and of their edited texts, with likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of every language, and the terms that tell them apart."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along their 8 first components."""
    return whiten(table(spark, sf_dir, "embeddings"), components=8)
