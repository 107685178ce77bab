"""Benchmark items and questions in, predictions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def question_id(question: Column) -> Column:
    """60 bits of the question's hash as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(question, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def read_benchmark_json(
    spark: SparkSession, path: str, question_field: str = "question", gold_field: str = "context_files", lines: bool = False
) -> DataFrame:
    """``(query_id, question, gold, position)``. The id is made from the question, so it does not depend on how
    files are read. A file is one JSON array, or has one item a ``line``."""
    schema = f"`{question_field}` string, `{gold_field}` array<string>"
    items = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return items.select(
        question_id(F.col(question_field)).alias("query_id"),
        F.col(question_field).alias("question"),
        F.col(gold_field).alias("gold"),
        F.monotonically_increasing_id().alias("position"),
    )


def scan_benchmark(items: DataFrame, max_instances: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``queries (query_id, question)`` and ``qrels (query_id, doc_id, relevance)``."""
    items = items if max_instances is None else limit_instances(items, max_instances)
    qrels = items.select(
        "query_id", F.explode(F.array_distinct("gold")).alias("doc_id"), F.lit(1).alias("relevance")
    )
    return items.select("query_id", "question"), qrels


def limit_instances(items: DataFrame, n: int) -> DataFrame:
    """The first items: by their place in the file if that is known, else by id."""
    return items.orderBy("position" if "position" in items.columns else "query_id").limit(n)


def scan_question_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string").option("multiLine", True).option("escape", '"').csv(
        path, header=True
    )


def predictions(hits: DataFrame, n: int = 3, questions: DataFrame | None = None) -> DataFrame:
    """``(id, documents)``: the n best documents per query as a JSON array.

    With ``questions(query_id, …)`` each of them has a row, with an empty array where nothing was found.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc"))))
    top = hits.filter(F.col("rank") <= n)
    found = top.groupBy(F.col("query_id").alias("id")).agg(
        F.to_json(F.transform(ordered, lambda x: x["doc"])).alias("documents")
    )
    if questions is None:
        return found
    asked = questions.select(F.col("query_id").alias("id")).distinct()
    return asked.join(found, "id", "left").withColumn("documents", F.coalesce("documents", F.lit("[]")))


def write_predictions_csv(hits: DataFrame, path: str, n: int = 3, questions: DataFrame | None = None) -> None:
    predictions(hits, n, questions).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
