"""Whole retrievers: tables of questions in, ranked documents with their metadata out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import detect_language
from ..functions.tokens import path_terms, terms
from ..functions.vectors import hashed_embedding
from . import bm25, dense, path_match
from .ranking import with_metadata
from .symbols import symbol_array


def embedded_questions(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", hashed_embedding(F.col("question")).alias("embedding"))


def retrieve_dense(docs: DataFrame, queries: DataFrame, k: int, columns: list[str], **options) -> DataFrame:
    """``docs`` has ``(doc_id, embedding, *columns)``; metadata is joined to the k hits only."""
    hits = dense.topk_cosine(docs, queries, k, **options)
    return with_metadata(hits, docs, columns, at_most=k * queries.count())


def retrieve_sparse(
    docs: DataFrame, questions: DataFrame, k: int, columns: list[str], stats: DataFrame | None = None
) -> DataFrame:
    """``docs`` has ``(doc_id, text, *columns)``, ``questions`` ``(query_id, question)``."""
    asked = questions.select("query_id", terms(F.col("question")).alias("terms"))
    hits = bm25.topk_bm25(bm25.term_frame(docs), asked, k, stats)
    return with_metadata(hits, docs, columns, at_most=k * questions.count())


def path_documents(files: DataFrame) -> DataFrame:
    """``(doc_id, terms)`` of each file's path and symbol names."""
    # The language and the symbols are columns of their own, as they are asked for several times.
    found = files.select("file_path", "content", detect_language(F.col("file_path")).alias("_language")).select(
        "file_path", symbol_array(F.col("content"), F.col("_language")).alias("_symbols")
    )
    names = F.transform("_symbols", lambda s: F.concat_ws(" ", s["class_name"], s["method_name"]))
    # A blank ends a word, so that all names are cut into words at once.
    text = F.concat_ws(" ", "file_path", names)
    return found.select(
        F.col("file_path").alias("doc_id"), F.when(F.col("file_path").isNotNull(), path_terms(text)).alias("terms")
    )


def retrieve_by_path(
    files: DataFrame,
    questions: DataFrame,
    k: int,
    picker: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Files chosen by path and symbols only: ``(query_id, file_path, rank)``.

    The default scores those names by BM25. A ``picker`` gets the questions and returns
    guesses ``(query_id, namespace, position, guess)``, which are validated and cut to k.
    """
    if picker is not None:
        return path_match.validate_paths(picker(questions), files, k).select("query_id", "file_path", "rank")
    asked = questions.select("query_id", path_terms(F.col("question")).alias("terms"))
    hits = bm25.topk_bm25(path_documents(files), asked, k)
    return hits.select("query_id", F.col("doc_id").alias("file_path"), "score", "rank")
