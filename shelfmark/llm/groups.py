"""Pairs of rows within groups, for groups of any size.

Rows that share a key are compared with each other inside tasks. A key that holds more rows than
a task should compare is cut into parts by the hash of an identity column; each pair of parts is
a *tile* of its own, so no task holds more than two parts of a group. Which keys are large is
estimated from a sample; the estimate decides how rows are laid out and never which pairs meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SMALL_ROWS

#: Rows of a group that are compared in one task; larger groups are cut into parts of this size.
PART_ROWS = 16_384

#: Index pairs that are handled at a time.
PAIR_BLOCK = 1_000_000

#: Rows gathered before complete groups are worked on.
BUFFER_ROWS = 200_000

WHOLE, LEFT, RIGHT = 0, 1, 2


def large_keys(sampled: DataFrame, key: str, share: int, part_rows: int = PART_ROWS) -> DataFrame | None:
    """``(key, parts)`` of the keys whose estimated row count exceeds ``part_rows``.

    ``sampled`` holds about one in ``share`` of the rows. None when there are no such keys.
    """
    counted = sampled.groupBy(key).count().where(F.col("count") * share > part_rows)
    parts = stored(counted.select(key, F.ceil(F.col("count") * share / part_rows).cast("int").alias("parts")), "large-keys")
    n = parts.count()
    if n == 0:
        return None
    return F.broadcast(parts) if n <= SMALL_ROWS else parts


def tiled(rows: DataFrame, large: DataFrame | None, key: str, identity: str) -> DataFrame:
    """Adds ``tile`` and ``side``: rows of a large key go to every tile that their part meets."""
    if large is None:
        return rows.withColumns({"tile": F.lit(0), "side": F.lit(WHOLE)})
    joined = rows.join(large, key, "left").withColumn("part", F.pmod(F.xxhash64(identity), F.col("parts")).cast("int"))

    def tile(other):
        low, high = F.least("part", other), F.greatest("part", other)
        side = F.when(F.col("part") == other, WHOLE).when(F.col("part") < other, LEFT).otherwise(RIGHT)
        return F.struct((low * F.col("parts") + high).alias("tile"), side.alias("side"))

    tiles = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("tile"), F.lit(WHOLE).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), tile)
    )
    placed = joined.withColumn("_place", F.explode(tiles)).drop("parts", "part")
    return placed.withColumns({"tile": F.col("_place.tile"), "side": F.col("_place.side")}).drop("_place")


def index_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all groups ``[start, end)``, in blocks: each row of a whole group with every
    later one, each left row of a tile with every right one."""
    sizes = ends - starts
    wanted = sizes > 1
    starts, ends = starts[wanted], ends[wanted]
    if not len(starts):
        return
    # Every row is a first one; its partners are a range [low, high).
    rows = ranges(starts, ends)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    counted = np.concatenate([[0], np.cumsum(side == RIGHT)])
    right = counted[ends] - counted[starts]
    high = ends[group]
    low = np.where(side[rows] == LEFT, high - right[group], np.where(side[rows] == RIGHT, high, rows + 1))
    yield from range_pairs(rows, low, high)


def range_pairs(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each of ``rows`` with the range ``[low, high)`` of its partners, in blocks."""
    count = np.maximum(high - low, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIR_BLOCK, side="right")))
        n = count[at:to]
        first = np.repeat(rows[at:to], n)
        if len(first):
            yield first, ranges(low[at:to], high[at:to])
        at = to


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``concatenate(arange(a, b) for each a, b)``."""
    n = high - low
    keep = n > 0
    low, n = low[keep], n[keep]
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(int(n.sum()), dtype=np.int64)
    out[0] = low[0]
    at = np.cumsum(n)[:-1]
    out[at] = low[1:] - (low[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as one link per node to the smallest node of its component, which links the same nodes."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    while not np.array_equal(root, root[root]):
        root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def scan_groups(
    placed: DataFrame,
    key: str,
    order: list[str],
    work: Callable[[dict[str, object], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """Run ``work(columns, starts, ends)`` over the complete groups of ``(key, tile)``.

    ``placed`` is the result of :func:`tiled`, or rows whose key alone names their group. Numbers come as numpy arrays, everything else as
    Arrow arrays; within a group rows are sorted by side, then ``order``. Groups stream through a
    task in key order and only as many rows as a buffer plus one group are held; ``buffer_rows`` should be small
    where rows are large.
    """
    names = placed.columns
    by = [c for c in (key, "tile") if c in names]
    dealt = placed.repartition(*by).sortWithinPartitions(*by, *(["side"] if "side" in names else []), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= buffer_rows:
                whole = pa.Table.from_batches(held)
                keys = [whole.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in by]
                other = np.logical_or.reduce([k != k[-1] for k in keys])
                last = int(np.flatnonzero(other)[-1]) + 1 if other[0] else 0
                if last:
                    yield from _grouped(whole.slice(0, last))
                    held = whole.slice(last).to_batches()
                    rows -= last
        if held:
            yield from _grouped(pa.Table.from_batches(held))

    def _grouped(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        columns: dict[str, object] = {}
        for name in names:
            column = whole.column(name).combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            plain = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type) or pa.types.is_floating(column.type)
            columns[name] = column.to_numpy(zero_copy_only=False) if plain else column
        new = np.flatnonzero(np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in by])) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [whole.num_rows]])
        yield from work(columns, starts, ends)

    return dealt.mapInArrow(run, schema)
