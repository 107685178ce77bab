"""Helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: A side is broadcast only when its measured row count is at most this.
SMALL_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def hinted(df: DataFrame, label: str, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` written once; with a broadcast hint when it has at most ``max_rows`` rows.

    Beyond that the join that reads it is left to the optimizer, which shuffles both sides.
    """
    kept = stored(df, label)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of column ``size`` come to about ``limit`` bytes at most
    in each; a single longer row is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(size).cast(pa.binary())), 0).to_numpy().astype(np.int64)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


#: Bits of a filter of digests.
FILTER_BITS = 26


def digest_filter(digests: DataFrame, a: str, b: str) -> np.ndarray:
    """Pairs of 64-bit digests as a bit array of fixed size, made where they are and sent to the driver as at most 2^20 words."""
    mask = (1 << FILTER_BITS) - 1
    places = [F.col(h) if not shift else F.shiftright(F.col(h), shift) for h in (a, b) for shift in (0, FILTER_BITS)]
    place = digests.select(F.explode(F.array(*[p.bitwiseAND(F.lit(mask)) for p in places])).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b"))
    table = words.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return bits


def in_filter(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False for digests that are surely not in the filter."""
    mask = (1 << FILTER_BITS) - 1
    found = np.ones(len(a), dtype=bool)
    for column in (a.view(np.int64), b.view(np.int64)):
        for shift in (0, FILTER_BITS):
            place = (column >> shift) & mask
            found &= (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found
