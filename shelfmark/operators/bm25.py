"""BM25 over any frame of ``(doc_id, text or terms)``.

``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``, weight ``tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import explode_computed
from ..functions.tokens import term_counts, terms
from ..session import fits, stored
from .ranking import DIGITS, top_k

K1 = 1.2
B = 0.75
#: Copies of the query side when it is too large to broadcast, so that one frequent
#: term is spread over that many join tasks.
SALTS = 32
#: Rows of documents by question and term that a task adds up; with this many it holds some hundred MB at most.
SCORED_ROWS = 2_000_000


def term_frame(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, terms)``; any other array of terms will do for the functions below."""
    return docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)``, counted inside the row: no shuffle."""
    counted = docs.select("doc_id", F.size("terms").alias("dl"), term_counts(F.col("terms")).alias("p"))
    return explode_computed(counted, ["doc_id", "dl"], "p", "p").select("doc_id", "dl", "p.term", "p.tf")


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, dl: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (F.lit(1.0 - B) + B * dl / avg_len))


def bm25_fit(docs: DataFrame, only_terms: DataFrame | None = None) -> DataFrame:
    """Statistics ``(term, df, n_docs, avg_len)``, of all terms or of those asked for."""
    found = postings(docs).select("term")
    if only_terms is not None:
        found = found.join(small(only_terms.select("term").distinct()), "term", "left_semi")
    totals = corpus_totals(docs)
    return found.groupBy("term").agg(F.count("*").alias("df")).select(
        "term",
        "df",
        totals.select("n_docs").scalar().alias("n_docs"),
        totals.select("avg_len").scalar().alias("avg_len"),
    )


def bm25_encode(docs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Sparse vectors as rows ``(doc_id, term, weight)``."""
    totals = corpus_totals(docs) if totals is None else totals
    return postings(docs).select(
        "doc_id", "term", tf_weight(F.col("tf"), F.col("dl"), totals.select("avg_len").scalar()).alias("weight")
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when it is measured to be small, else leave the choice to Spark."""
    return F.broadcast(df) if fits(df) else df


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct ``(query_id, term)`` of ``(query_id, terms)``."""
    return explode_computed(queries, ["query_id"], F.array_distinct("terms"), "term")


def _wanted_postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted terms, and one row with an empty term per document for its length.

    One narrow pass over the texts. It is stored because the statistics and the scores both
    come from it; it holds the query's words only, not the corpus.
    """
    length_row = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("tf")))
    counted = docs.select(
        "doc_id",
        F.size("terms").alias("dl"),
        F.concat(length_row, F.coalesce(term_counts(F.col("terms")), F.array())).alias("p"),
    )
    rows = explode_computed(counted, ["doc_id", "dl"], "p", "p").select("doc_id", "dl", "p.term", "p.tf")
    vocabulary = wanted.select("term").distinct().unionByName(
        wanted.sparkSession.range(1).select(F.lit("").alias("term"))
    )
    return stored(rows.join(F.broadcast(vocabulary), "term", "left_semi"), "postings")


def postings_join(docs: DataFrame, queries: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, term, weight)`` for every query term a document has."""
    return _weighted_postings(docs, queries, stats, lambda weight: weight.alias("weight"))


def _weighted_postings(
    docs: DataFrame, queries: DataFrame, stats: DataFrame | None, of: Callable[[Column], Column]
) -> DataFrame:
    """``(query_id, doc_id, term, …)`` for every query term a document has, with a column made of the weight.

    The query side is measured first. When it is small the documents' postings are reduced
    to query terms in place and only those are shuffled, by document, so that everything up
    to the local top-k is computed where a document's postings lie. They are dealt to so many
    tasks that each has a bounded number of rows after the join, which are many more than its
    postings. Otherwise both sides are shuffled by term and salt.
    """
    wanted = query_terms(queries)
    weight = idf(F.col("n_docs"), F.col("df")) * tf_weight(F.col("tf"), F.col("dl"), F.col("avg_len"))
    output = ("doc_id", "term", of(weight))
    if fits(wanted):
        if stats is None:
            found = _wanted_postings(docs, wanted)
            lengths = found.filter("term = ''").agg(
                F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len")
            )
            found = found.filter("term <> ''")
            stats = found.groupBy("term").agg(F.count("*").alias("df")).select(
                "term",
                "df",
                lengths.select("n_docs").scalar().alias("n_docs"),
                lengths.select("avg_len").scalar().alias("avg_len"),
            )
        else:
            vocabulary = F.broadcast(wanted.select("term").distinct())
            found = postings(docs).join(vocabulary, "term", "left_semi")
        # A term has one row of statistics and of questions, so that a weight is computed once for all of these.
        asked = wanted.groupBy("term").agg(F.collect_list(F.struct("query_id")).alias("asked"))
        weighted = stored(asked.join(stats, "term"), "weighted")
        rows = weighted.agg(F.sum(F.col("df") * F.size("asked"))).first()[0] or 0
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // SCORED_ROWS))
        dealt = found.repartition(tasks, "doc_id").join(F.broadcast(weighted), "term").select("asked", *output)
        return dealt.select(F.explode("asked").alias("a"), *dealt.columns[1:]).select("a.query_id", *dealt.columns[1:])
    stats = bm25_fit(docs, wanted) if stats is None else stats
    salted = postings(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = wanted.join(stats, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["term", "salt"]).select("query_id", *output)


def topk_bm25(docs: DataFrame, queries: DataFrame, k: int, stats: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the k best documents; ties by ``doc_id``.

    Weights are added in whole units of the last digit, so the order in which they come does not show.
    """
    scores = (
        _weighted_postings(docs, queries, stats, lambda weight: F.round(weight * 10.0**DIGITS).cast("long").alias("units"))
        .groupBy("doc_id", "query_id")
        .agg((F.sum("units") / 10.0**DIGITS).alias("score"))
    )
    return top_k(scores, k)
