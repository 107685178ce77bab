"""Vectors that arrive as files, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index


def stream_upsert(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    index: Index,
    checkpoint: str,
    first_commit: int = 1,
    max_files: int = 100,
    prepare=lambda df: df,
) -> StreamingQuery:
    """Read new Parquet files and write each micro-batch as one commit of the index.

    The commit number follows from the batch number, so a batch that is replayed after a
    failure rewrites its own commit and nothing else.
    """

    def write(batch: DataFrame, batch_no: int) -> None:
        index.upsert(prepare(batch), first_commit + batch_no)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
