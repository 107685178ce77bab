"""Rank metrics over retrieved lists, binary relevance, averaged over the judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import best_per_document, by_score

#: Metrics of two runs that differ by less are the same.
CLOSE = 1e-9
METRICS = ("rprec", "p1", "r3", "ndcg3", "map", "mrr")
CUT = 3


def join_qrels(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits, best score per document, ranked, with relevance 0 where there is no judgement."""
    ranked = best_per_document(hits).withColumn("rank", F.row_number().over(by_score()))
    return ranked.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn(
        "relevance", F.coalesce("relevance", F.lit(0))
    )


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.filter("relevance > 0").groupBy("query_id").agg(F.count("*").alias("n_relevant"))


def per_query(judged: DataFrame, totals: DataFrame) -> DataFrame:
    """The six metrics per query of ``totals (query_id, n_relevant)``; 0 for queries without hits.

    ``judged`` is ``(query_id, rank, relevance)`` and bounded by the depth of retrieval.
    """
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = judged.select(
        "query_id", "rank", "relevance", F.sum("relevance").over(so_far).alias("found")
    )
    rank, rel, n = F.col("rank"), F.col("relevance"), F.col("n_relevant")
    gain = rel / F.log2(rank + 1.0)
    cut = rank <= CUT
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(CUT), n).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1.0),
    )
    sums = (
        totals.join(hits, "query_id", "left")
        .groupBy("query_id", "n_relevant")
        .agg(
            F.sum(F.when(rank <= n, rel)).alias("in_r"),
            F.sum(F.when(rank == 1, rel)).alias("at_1"),
            F.sum(F.when(cut, rel)).alias("in_cut"),
            F.sum(F.when(cut, gain)).alias("dcg"),
            F.sum(F.when(rel > 0, F.col("found") / rank)).alias("precisions"),
            F.min(F.when(rel > 0, rank)).alias("first"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        "query_id",
        zero(F.col("in_r") / n).alias("rprec"),
        zero(F.col("at_1").cast("double")).alias("p1"),
        zero(F.col("in_cut") / n).alias("r3"),
        zero(F.col("dcg") / ideal).alias("ndcg3"),
        zero(F.col("precisions") / n).alias("map"),
        zero(F.lit(1.0) / F.col("first")).alias("mrr"),
    )


def mean_of(scores: DataFrame, metric: str) -> DataFrame:
    return scores.agg(F.round(F.avg(metric), 6).alias(metric))


def eval_report(scores: DataFrame, run_id: str) -> DataFrame:
    return scores.agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS]).select(
        F.lit(run_id).alias("run_id"), *METRICS
    )


def compare_runs(scores: DataFrame, baseline: str) -> DataFrame:
    """``(run_id, metric, mean, difference, wins, losses)`` of every run and metric against one run.

    ``scores`` has the metrics of each question and run, ``(run_id, query_id, …)``. The difference of the means and the
    questions won and lost are over the questions that both runs have.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("v")
    each = scores.select("run_id", "query_id", values).select("run_id", "query_id", "v.metric", "v.value")
    base = each.filter(F.col("run_id") == baseline).select("query_id", "metric", F.col("value").alias("base"))
    both = each.join(base, ["query_id", "metric"], "left")
    ahead = F.col("value") - F.col("base")
    return both.groupBy("run_id", "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.avg(ahead), 6).alias("difference"),
        F.sum((ahead > CLOSE).cast("int")).alias("wins"),
        F.sum((ahead < -CLOSE).cast("int")).alias("losses"),
    )


def extension_share(hits: DataFrame, ext: str = "ext") -> DataFrame:
    """Share of the retrieved documents per file extension and run."""
    per_ext = hits.groupBy("run_id", ext).agg(F.count("*").alias("n"))
    total = Window.partitionBy("run_id")
    return per_ext.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6))


def report_json(scores: DataFrame, judged: DataFrame, flags: dict[str, str], run_id: str) -> DataFrame:
    """The report of a run as JSON lines: per query its hits and metrics, with the run's flags."""
    hits = judged.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "relevance"))).alias("hits")
    )
    flag_map = F.create_map(*[F.lit(x) for kv in sorted(flags.items()) for x in kv]) if flags else F.lit(None)
    return scores.join(hits, "query_id", "left").select(
        F.lit(run_id).alias("run_id"),
        "query_id",
        F.to_json(F.struct("query_id", *METRICS, "hits", flag_map.alias("flags"))).alias("report"),
    )


def write_eval_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("run_id").json(path)
