"""Request and result files of batch embedding services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The endpoint, and the models that take a number of dimensions.
ENDPOINT = "/v1/embeddings"
MODELS_WITH_DIMENSIONS = ("text-embedding-3-small", "text-embedding-3-large")
RESULT_SCHEMA = (
    "custom_id string, response struct<body:struct<data:array<struct<index:int,embedding:array<float>>>>>"
)


def batch_requests(batched: DataFrame, model: str, dimensions: int | None = None) -> DataFrame:
    """``(batch_id, request)``: one JSON request per batch of ``(batch_id, pos, text)``."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    texts = F.transform(ordered, lambda x: x["text"])
    body = [F.lit(model).alias("model"), F.col("texts").alias("input")]
    if dimensions is not None and model in MODELS_WITH_DIMENSIONS:
        body.append(F.lit(dimensions).alias("dimensions"))
    request = F.struct(
        F.col("batch_id").alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(ENDPOINT).alias("url"),
        F.struct(*body).alias("body"),
    )
    return batched.groupBy("batch_id").agg(texts.alias("texts")).select(
        "batch_id", F.to_json(request).alias("request")
    )


def write_batch_requests(requests: DataFrame, path: str) -> None:
    requests.select("request").write.mode("overwrite").text(path)


def parse_batch_results(lines: DataFrame) -> DataFrame:
    """``(batch_id, pos, embedding)`` from JSON lines in a ``value`` column."""
    parsed = lines.select(F.from_json("value", RESULT_SCHEMA).alias("r"))
    return parsed.select(
        F.col("r.custom_id").alias("batch_id"), F.inline("r.response.body.data")
    ).withColumnRenamed("index", "pos")


def batch_result_errors(lines: DataFrame) -> DataFrame:
    """``(batch_id, line, reason)`` of the lines that give no vectors: no JSON, or a response without data."""
    result = F.from_json("value", RESULT_SCHEMA)
    parsed = lines.select(F.col("value").alias("line"), result.alias("r")).filter(F.trim("line") != "")
    no_id, no_data = F.col("r.custom_id").isNull(), F.coalesce(F.size("r.response.body.data"), F.lit(-1)) < 1
    reason = F.when(no_id, "no batch result").when(no_data, "no vectors")
    return parsed.select(F.col("r.custom_id").alias("batch_id"), "line", reason.alias("reason")).filter("reason is not null")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_batch_results(spark.read.text(path))


def join_batch_results(batched: DataFrame, results: DataFrame) -> DataFrame:
    """Vectors back to their chunks by batch and position."""
    return batched.join(results, ["batch_id", "pos"])
