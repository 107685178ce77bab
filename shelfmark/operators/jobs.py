"""Logs of embedding jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("completed", "failed")


def job_status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def all_jobs_ready(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("dataset").agg(F.every(F.col("status").isin(*FINAL)).alias("ready"))


def filter_failed_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs whose results can be read, and the others with the reason."""
    failed = F.col("status") == "failed"
    missing = F.col("output_file_id").isNull()
    errors = jobs.filter(failed | missing).withColumn(
        "reason", F.when(failed, "failed").otherwise("no output")
    )
    return jobs.filter(~failed & ~missing), errors
