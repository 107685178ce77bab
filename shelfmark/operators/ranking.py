"""Ranks, fusion of ranked lists and reranking. A list is ``(query_id, doc_id, score, rank)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tokens import terms
from ..session import BROADCAST_ROWS

RRF_CONSTANT = 60
DEFAULT_RERANKED = 5
#: Digits behind the point that sums are ranked by; behind these they depend on the order of their terms.
DIGITS = 12


def by_score(score: str = "score") -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows per query. Spark keeps k per query and task before the shuffle."""
    ranked = scores.withColumn("rank", F.row_number().over(by_score()))
    return ranked.filter(F.col("rank") <= k)


def rank_hits(hits: DataFrame, position: str = "position") -> DataFrame:
    """Score from what the retriever left: ``score``, else ``relevance_score``, else the position."""
    scored = hits.withColumn(
        "score",
        F.coalesce("score", "relevance_score", F.lit(1.0) / (F.col(position) + 1)),
    )
    return scored.withColumn("rank", F.row_number().over(by_score()))


def best_per_document(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def multi_query_union(hits: DataFrame) -> DataFrame:
    """Union over the variants of a query: best score per document, ranked again, not cut."""
    return best_per_document(hits).withColumn("rank", F.row_number().over(by_score()))


def hybrid_rrf(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """Weighted reciprocal-rank fusion."""
    share = lambda hits, w: hits.select(
        "query_id", "doc_id", (F.lit(float(w)) / (F.col("rank") + RRF_CONSTANT)).alias("part")
    )
    fused = (
        share(dense, alpha)
        .unionByName(share(sparse, 1 - alpha))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("part"), DIGITS).alias("score"))
    )
    return top_k(fused, k)


def min_max(hits: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] per query; all equal scores become 1."""
    query = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(query), F.max("score").over(query)
    scaled = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0)
    return hits.select("query_id", "doc_id", scaled.alias("scaled"))


def hybrid_weighted(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """``alpha`` times the scaled dense score plus ``1 - alpha`` times the scaled sparse score."""
    if alpha >= 1:
        return top_k(dense.select("query_id", "doc_id", "score"), k)
    if alpha <= 0:
        return top_k(sparse.select("query_id", "doc_id", "score"), k)
    share = lambda hits, w: min_max(hits).select("query_id", "doc_id", (F.lit(w) * F.col("scaled")).alias("part"))
    mixed = (
        share(dense, alpha)
        .unionByName(share(sparse, 1 - alpha))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("part"), DIGITS).alias("score"))
    )
    return top_k(mixed, k)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query words that the text has."""
    wanted = F.array_distinct(terms(query))
    found = F.size(F.array_intersect(wanted, terms(text)))
    return F.round(F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(0.0), 6)


def with_metadata(hits: DataFrame, docs: DataFrame, columns: list[str], at_most: int | None = None) -> DataFrame:
    """Adds columns of the documents to the hits.

    ``at_most`` is the caller's bound on the number of hits, as a rule k times the number of
    questions. Hits bounded to few rows are broadcast, so the documents are not shuffled.
    """
    if at_most is not None and at_most <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return docs.select("doc_id", *columns).join(hits, "doc_id").select(*hits.columns, *columns)


def model_scores(pairs: DataFrame, model: Callable[[list[str], list[str]], Sequence[float]], batch_size: int) -> DataFrame:
    """Adds ``rerank_score`` and ``error`` to ``pairs(…, question, text)`` by a model that may fail.

    The model is called with lists of questions and texts. A failing call gives its rows no score and the error.
    """
    schema = T.StructType([*pairs.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                questions, texts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("question", "text"))
                try:
                    scores, error = [float(x) for x in model(questions, texts)], None
                    if len(scores) != len(texts):
                        raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
                except Exception as e:  # noqa: BLE001 - any error of a model becomes rows
                    scores, error = [None] * len(texts), f"{type(e).__name__}: {e}"
                columns = [*part.columns, pa.array(scores, pa.float64()), pa.array([error] * len(texts), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "rerank_score", "error"])

    return pairs.mapInArrow(run, schema)


def rerank_topn(
    hits: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    n: int = DEFAULT_RERANKED,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    at_most: int | None = None,
    model: Callable[[list[str], list[str]], Sequence[float]] | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Score the retrieved pairs again and keep the n best of each query: ``(query_id, doc_id, score, fell_back, rank)``.

    ``scorer`` takes the question and text columns and returns a column, or ``model`` is called with lists of
    both. Only retrieved pairs reach them. A query of which any pair got no score, as a call has failed,
    keeps the order of retrieval; see :func:`rerank_fallback`. ``at_most`` bounds the number of hits as
    in ``with_metadata``.
    """
    asked = hits.select("query_id", "doc_id", "rank").join(queries.select("query_id", "question"), "query_id")
    pairs = with_metadata(asked, docs, ["text"], at_most)
    if model is None:
        scored = pairs.withColumns({"rerank_score": scorer(F.col("question"), F.col("text")).cast("double"), "error": F.lit(None).cast("string")})
    else:
        scored = model_scores(pairs, model, batch_size)
    failed = F.col("error").isNotNull()
    return rerank_fallback(scored.select("query_id", "doc_id", "rank", "rerank_score", failed.alias("error")), n)


def rerank_fallback(reranked: DataFrame, n: int = DEFAULT_RERANKED) -> DataFrame:
    """Order by the new score, or as retrieved for every query whose reranking failed anywhere.

    Input ``(query_id, doc_id, rank, rerank_score, error)``.
    """
    failed = (
        F.max(F.coalesce(F.col("error"), F.lit(False)) | F.col("rerank_score").isNull())
        .over(Window.partitionBy("query_id"))
    )
    score = F.when(failed, -F.col("rank").cast("double")).otherwise(F.col("rerank_score"))
    return top_k(
        reranked.select("query_id", "doc_id", score.alias("score"), failed.alias("fell_back")), n
    )
