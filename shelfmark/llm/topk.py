"""Exact top-k inner products by tiled matrix products.

Candidates are dealt to shards and queries to blocks of fixed size by the hash of their id; each
pair of a shard and a block is one tile. A task multiplies a tile's two matrices, keeps k per query
and drops the products; the short lists are then merged in a tree, a few dozen lists at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stored

K = 5
#: Vectors in a shard and in a block of queries.
SHARD_ROWS = 8_192
BLOCK_ROWS = 2_048
#: Lists that are merged at a time.
FAN_IN = 64
#: Products held at a time in a task.
PRODUCTS = 2_000_000
#: Components are scaled by this and rounded down.
SCALE = 256


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as long as they fit a long.

    Floating point is used only where every partial sum is a whole number below 2**53.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the ``k`` highest scores, of equal ones the first, in this order."""
    n = scores.shape[1]
    if n > 4 * k:
        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = (scores > limit).sum(axis=1, keepdims=True)
        tied = scores == limit
        kept = (scores > limit) | (tied & (np.cumsum(tied, axis=1) <= k - above))
        columns = np.nonzero(kept)[1].reshape(len(scores), k)
        order = np.argsort(-np.take_along_axis(scores, columns, axis=1), axis=1, kind="stable")
        return np.take_along_axis(columns, order, axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with ``v = floor(scale * x)`` per component x as double; rows whose vector is null,
    empty, or holds null or values that are not finite are left out."""
    x = F.col("_v")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    own = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("_v"))
    return own.where(usable & F.col("id").isNotNull()).select("id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row of ``queries(id, v)`` its ``k`` highest inner
    products among ``candidates(id, v)``, all if there are fewer, ties to the smaller id.

    A row is no candidate of a query with its id. Queries with one id are one query (the largest
    vector of them); candidates with one id are candidates each. Vectors meet only those of the same
    length. No queries or no candidates give no rows.
    """
    asked = stored(queries.groupBy("id").agg(F.max("v").alias("v")), "queries")
    known = stored(candidates, "vectors")
    shards = max(1, -(-known.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    dims = F.size("v").alias("dims")
    left = asked.select(
        dims, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v"
    )
    right = known.select(
        dims, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "id", "v"
    )
    names = ["dims", "block", "shard"]

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "shard": [], "id": [], "score": []}).astype("int64")
        c = c.sort_values("id", kind="stable")
        ids, matrix, asked_ids = c["id"].to_numpy(), _matrix(c["v"]), q["id"].to_numpy()
        step, out = max(1, PRODUCTS // len(c)), []
        for at in range(0, len(q), step):
            own = asked_ids[at : at + step]
            scores = products(_matrix(q["v"].iloc[at : at + step]), matrix)
            same = own[:, None] == ids[None, :]
            take = min(len(c), k + int(same.sum(axis=1).max()))
            columns = best(scores, take)
            rows = np.repeat(np.arange(len(own)), take)
            flat = columns.ravel()
            keep = ~same[rows, flat]
            keep &= (np.cumsum(keep.reshape(len(own), take), axis=1) <= k).ravel()
            rows, flat = rows[keep], flat[keep]
            out.append(pd.DataFrame({"query_id": own[rows], "shard": int(c["shard"].iloc[0]), "id": ids[flat], "score": scores[rows, flat]}))
        return pd.concat(out)

    lists = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(tile, "query_id long, shard long, id long, score long")
    order = [F.col("score").desc(), F.col("id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("long"))
        lists = lists.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "id", "score")
