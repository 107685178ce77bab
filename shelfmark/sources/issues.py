"""Landed issue and comment JSON as issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE_JSON = "url string, html_url string, title string, body string, pull_request struct<url:string>"
COMMENT_JSON = "issue_url string, url string, html_url string, body string, pos bigint"
COMMENTS = "array<struct<url:string,html_url:string,body:string>>"


def read_issue_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ISSUE_JSON).json(path)


def read_comment_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMENT_JSON).json(path)


def join_issue_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues with their comments nested in order; none found gives an empty array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "url", "html_url", "body")))
    nested = comments.groupBy(F.col("issue_url").alias("html_url")).agg(
        F.transform(
            ordered,
            lambda c: F.struct(c["url"].alias("url"), c["html_url"].alias("html_url"), c["body"].alias("body")),
        ).alias("comments")
    )
    empty = F.array().cast(COMMENTS)
    return issues.join(nested, "html_url", "left").withColumn("comments", F.coalesce("comments", empty))


def scan_issues(issues: DataFrame, comments: DataFrame | None = None, max_issues: int | None = None) -> DataFrame:
    """``(url, html_url, title, body, comments)``: no pull requests, no null bodies."""
    rows = issues.filter(F.col("pull_request").isNull()).select(
        "url", "html_url", "title", F.coalesce("body", F.lit("")).alias("body")
    )
    if max_issues is not None:
        rows = rows.orderBy("html_url").limit(max_issues)
    if comments is None:
        return rows.withColumn("comments", F.array().cast(COMMENTS))
    return join_issue_comments(rows, comments).select("url", "html_url", "title", "body", "comments")
