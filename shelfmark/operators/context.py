"""What goes into a prompt: links, history, passages. Prompts are columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REWRITE_INSTRUCTION = (
    "Rewrite the last message of the conversation as one question that can be understood alone. "
    "Do not answer it."
)
ANSWER_INSTRUCTION = (
    "You help with questions about a code base. Use the passages below where they apply "
    "and say so when they do not answer the question."
)
PICKER_INSTRUCTION = (
    "Below is an outline of a repository. Name the {k} files most likely to hold the answer "
    "to the question, one full path per line and nothing else."
)


def source_links(hits: DataFrame) -> DataFrame:
    """Markdown links per query in rank order, each once; ``(query_id, rank, file_path, url)``."""
    label = F.coalesce(F.col("file_path"), F.col("url"))
    link = F.concat(F.lit("["), label, F.lit("]("), F.col("url"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", link.alias("link"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["link"])), "\n").alias("sources")
    )


def history_context(turns: DataFrame, last: int | None = None) -> DataFrame:
    """For each user message the turns before it, ``(conv_id, turn, text, history)``.

    A conversation is the unit of work here, as a file is for chunking. ``last`` limits the
    history to that many turns, for conversations that do not end.
    """
    first = Window.unboundedPreceding if last is None else -last
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(first, -1)
    lines = F.transform(
        F.collect_list(F.struct("role", "text")).over(before),
        lambda t: F.concat(t["role"], F.lit(": "), t["text"]),
    )
    return (
        turns.withColumn("history", F.array_join(lines, "\n"))
        .filter(F.col("role") == "user")
        .select("conv_id", "turn", "text", "history")
    )


def standalone_question(history: DataFrame) -> DataFrame:
    prompt = F.when(
        F.col("history") != "",
        F.concat_ws("\n\n", F.lit(REWRITE_INSTRUCTION), "history", F.concat(F.lit("Last message: "), "text")),
    ).otherwise(F.col("text"))
    return history.select("conv_id", "turn", prompt.alias("prompt"))


def rag_prompt(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, prompt)`` from ranked passages ``(query_id, rank, text)`` and
    ``(query_id, question, history)``; questions without passages get a prompt too."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    passages = hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("passages")
    )
    return questions.join(passages, "query_id", "left").select(
        "query_id",
        F.concat_ws(
            "\n\n",
            F.lit(ANSWER_INSTRUCTION),
            F.coalesce("passages", F.lit("")),
            F.when(F.col("history") != "", F.col("history")),
            F.concat(F.lit("Question: "), "question"),
        ).alias("prompt"),
    )


def picker_prompt(outlines: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """System and user part per question; the outline is bounded by its token limit."""
    return questions.join(outlines, "namespace").select(
        "query_id",
        "namespace",
        F.concat_ws("\n\n", F.lit(PICKER_INSTRUCTION.format(k=k)), "outline").alias("system_prompt"),
        F.concat(F.lit("Question: "), "question").alias("user_prompt"),
    )
