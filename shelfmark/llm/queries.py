"""The operators of this folder as queries over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_chunks, decontaminate, line_dedup, pii, prefix_trie, quality, repeats, secrets, sentencepiece_tokens, simhash, topk, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that occur in windows of the benchmark."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that a document is junk, repeats itself or is toxic, and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without long repeated byte strings."""
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages, by rule or by the trust of their host."""
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best inner products of every fiftieth vector with all others."""
    vectors = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(vectors.where("id % 50 = 0"), vectors)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by a SentencePiece model, with parity and round trip."""
    return sentencepiece_tokens.encode(table(spark, sf_dir, "documents"), sentencepiece_tokens.read_model())


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that are like an earlier line."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials in all documents."""
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op11_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by a byte-pair tokenizer, and what they decode to."""
    model = bpe_chunks.read_model()
    return bpe_chunks.encode(table(spark, sf_dir, "documents"), model, bpe_chunks.digests(model))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("key", "parent_key")


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in all documents."""
    return alignment.alignment(table(spark, sf_dir, "documents"), *alignment.read_models())
