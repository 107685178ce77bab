"""Connected components of a graph that is only ever held as a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``: ``root`` is the smallest node it is connected to.

    Alternates two star operations until nothing changes: first every node passes its larger
    neighbours on to its smallest one, then all its smaller neighbours. Each round is an
    aggregation by node, which is combined before the shuffle, and a join by node; rounds grow
    with the logarithm of a component's size. Rounds are written to the shared folder, so a lost
    executor costs no more than the round at hand. Null ends and links to oneself are ignored; no links give no rows.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    kept = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stored(kept.select(high.alias("u"), low.alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        passed = large.join(smallest, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        edges = stored(passed.distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
