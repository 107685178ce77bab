"""Issue threads: text forms and chunking by ranges of comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import explode_computed
from ..functions.tokens import count_tokens, truncate_tokens
from .chunking import COMMENT_SLACK

_RANGE = "struct<a:int,b:int>"


def comment_text(body: Column) -> Column:
    return F.concat(F.lit("## Comment: "), body)


def title_line(title: Column) -> Column:
    return F.concat(F.lit("# Issue: "), title)


def issue_head(title: Column, body: Column) -> Column:
    return F.concat(title_line(title), F.lit("\n"), body)


def comments_text(comments: Column, start: Column, end: Column) -> Column:
    chosen = F.slice(comments, start + 1, end - start)
    return F.array_join(F.transform(chosen, lambda c: comment_text(c["body"])), "\n\n")


def issue_text(issues: DataFrame) -> DataFrame:
    """One row per issue with the text of the issue and of all its comments."""
    comments = F.col("comments")
    n = F.size(comments)
    return issues.select(
        F.concat_ws("_", "html_url", F.lit("0"), n.cast("string")).alias("chunk_id"),
        F.col("html_url").alias("url"),
        F.concat(
            issue_head(F.col("title"), F.col("body")), F.lit("\n\n"), comments_text(comments, F.lit(0), n)
        ).alias("text"),
    )


def chunk_issue(issues: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of contiguous comments; the body is in the first chunk only, trimmed when too long.

    A comment that is over the limit by itself is kept whole in a chunk of its own.
    """
    title, body = F.col("title"), F.col("body")
    keep = F.greatest(F.lit(max_tokens - COMMENT_SLACK) - count_tokens(title), F.lit(0))
    trimmed = F.when(
        count_tokens(issue_head(title, body)) > max_tokens, issue_head(title, truncate_tokens(body, keep))
    ).otherwise(issue_head(title, body))
    df = issues.select(
        *[c for c in ("namespace",) if c in issues.columns],
        "html_url",
        title_line(title).alias("_title"),
        trimmed.alias("_head"),
        "comments",
        F.transform(
            "comments",
            lambda c: F.struct(
                count_tokens(c["body"]).alias("bare"), count_tokens(comment_text(c["body"])).alias("full")
            ),
        ).alias("_cost"),
    )
    df = df.withColumns({"_t": count_tokens(F.col("_title")), "_h": count_tokens(F.col("_head"))})
    zero = F.struct(
        F.lit(0).alias("i"),
        F.col("_h").alias("cur"),
        F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("open"),
        F.array().cast(f"array<{_RANGE}>").alias("done"),
    )

    def step(acc: Column, c: Column) -> Column:
        full = acc["cur"] + c["bare"] + COMMENT_SLACK > max_tokens
        after = acc["i"] + 1
        return F.struct(
            after.alias("i"),
            (F.when(full, F.col("_t")).otherwise(acc["cur"]) + c["full"]).alias("cur"),
            F.struct(
                F.when(full, acc["i"]).otherwise(acc["open"]["a"]).alias("a"), after.alias("b")
            ).alias("open"),
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
        )

    ranges = F.aggregate("_cost", zero, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    chunks = F.transform(
        ranges,
        lambda r, j: F.struct(
            r["a"].alias("start_comment"),
            r["b"].alias("end_comment"),
            F.concat(
                F.when(j == 0, F.col("_head")).otherwise(F.col("_title")),
                F.lit("\n\n"),
                comments_text(F.col("comments"), r["a"], r["b"]),
            ).alias("text"),
        ),
    )
    keys = [c for c in ("namespace",) if c in issues.columns]
    df = df.withColumnRenamed("html_url", "url")
    rows = explode_computed(df, [*keys, "url"], chunks, "c").select(*keys, "url", "c.*")
    return rows.withColumns(
        {
            "chunk_id": F.concat_ws(
                "_", "url", F.col("start_comment").cast("string"), F.col("end_comment").cast("string")
            ),
            "num_tokens": count_tokens(F.col("text")),
        }
    )
