"""Numbering and packing chunks into batches without sending a namespace through one task.

Batches are formed inside buckets. A bucket is a hash of the file path, so the largest
namespace is spread evenly, a file's chunks stay next to each other, and the numbers do not
depend on how Spark happens to partition the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

# Limits of known embedding services.
LIMITS = {
    "job": {"max_chunks": 2048, "max_tokens": 3_000_000},
    "request_small": {"max_chunks": 128, "max_tokens": 120_000},
    "request_medium": {"max_chunks": 128, "max_tokens": 320_000},
    "request_large": {"max_chunks": 128, "max_tokens": 1_000_000},
    "local": {"max_chunks": 64, "max_tokens": 8192 * 64},
}
TOKENS_PER_MINUTE = 900_000
REQUESTS_PER_MINUTE = 1_400
_MD5_DIGITS = 4
#: Buckets per namespace where their number does not show in the result's quality.
BUCKETS = 4096
#: Chunks whose batches are found together in a task.
BLOCK_ROWS = 65_536
#: Batches of a namespace that are numbered together in a plan of minutes.
BLOCK_BATCHES = 1024


def bucket_of(key: Column, buckets: int) -> Column:
    """Even, engine-independent hash bucket."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, _MD5_DIGITS), 16, 10)
    return (digits.cast("int") % buckets).cast("int")


def with_running_totals(
    df: DataFrame, by: list[str], bucket: Column, order: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Adds, for each named value, its sum over the group's rows up to and including this one.

    Order is ``(bucket, *order)``. Sums per bucket are taken first (partial aggregation) and
    their prefix sums, one row per group and bucket, are joined back; the row-level window
    then runs per bucket, not per group. ``df`` is read twice: store it first when it is
    costly to compute.
    """
    value, before, local = (lambda n: f"_value_{n}"), (lambda n: f"_before_{n}"), (lambda n: f"_local_{n}")
    rows = df.withColumns({"_bucket": bucket, **{value(n): c.cast("long") for n, c in totals.items()}})
    prefix = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(value(n)).alias(value(n)) for n in totals])
    offsets = sums.select(
        *by, "_bucket", *[F.coalesce(F.sum(value(n)).over(prefix), F.lit(0)).alias(before(n)) for n in totals]
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({local(n): F.sum(value(n)).over(within) for n in totals}).join(offsets, [*by, "_bucket"])
    helpers = ["_bucket", *[f(n) for n in totals for f in (value, before, local)]]
    return joined.withColumns({n: F.col(before(n)) + F.col(local(n)) for n in totals}).drop(*helpers)


def assign_batches(
    chunks: DataFrame,
    chunks_per_batch: int,
    buckets: int = BUCKETS,
    by: str = "namespace",
    bucket_key: str = "file_path",
    order: tuple[str, ...] = ("file_path", "start_pos"),
) -> DataFrame:
    """Dense batches per namespace: only the last one is short. Id is ``namespace/batch_no``."""
    numbered = with_running_totals(
        chunks, [by], bucket_of(F.col(bucket_key), buckets), list(order), {"_rn": F.lit(1)}
    )
    index = F.col("_rn") - 1
    return numbered.withColumns(
        {
            "batch_no": F.floor(index / chunks_per_batch).cast("long"),
            "pos": (index % chunks_per_batch).cast("int"),
        }
    ).withColumn("batch_id", F.concat_ws("/", by, F.col("batch_no").cast("string"))).drop("_rn")


def limit_batches(batched: DataFrame, max_jobs: int) -> DataFrame:
    return batched.filter(F.col("batch_no") < max_jobs)


def batch_collect(batched: DataFrame, text: str = "text") -> DataFrame:
    """Texts per batch in order; a batch is bounded by its number of chunks."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("text"))))
    return batched.groupBy("batch_id").agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def next_cuts(tokens: np.ndarray, max_chunks: int, max_tokens: int) -> np.ndarray:
    """Where the batch that begins at each chunk ends: both limits hold, but a batch has one chunk at least."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(len(tokens))
    fits = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    return np.maximum(at + 1, np.minimum(fits, at + max_chunks))


def _steps(tokens: np.ndarray, rows: int, max_chunks: int, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block does with each place where its first batch may begin: ``(place in the next block, batches begun)``.

    The block has the first ``rows`` chunks, the others are of the next one.
    """
    n = min(rows, max_chunks)
    cuts = next_cuts(tokens, max_chunks, max_tokens).tolist()
    leaves, begun = [0] * rows, [0] * rows
    for i in range(rows - 1, -1, -1):
        to = cuts[i]
        leaves[i], begun[i] = (to - rows, 1) if to >= rows else (leaves[to], begun[to] + 1)
    # A block with fewer rows than a batch is the last one; nothing enters it behind its end.
    return np.array(leaves[:n] + [0] * (max_chunks - n), dtype=np.int32), np.array(begun[:n] + [0] * (max_chunks - n), dtype=np.int64)


def _numbers(values: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=kind) for v in values.to_pylist()]


def _entries(blocks: DataFrame) -> DataFrame:
    """``(group, block, entry, base)``: where the first batch of every block begins, and how many there are before it.

    ``blocks(group, block, leaves, begun)`` tells what each block does. The steps of 1, 2, 4, … blocks are composed, and each
    round finds the entries of twice as many blocks: rounds grow with the logarithm of the blocks of a group.
    """
    reached = "group string, block bigint, entry int, base bigint"
    steps = "group string, block bigint, leaves binary, begun binary"

    def ahead(span: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, block, entry, base, leaves, begun = batch.columns
                at = entry.to_numpy(zero_copy_only=False)
                to = [int(x[e]) for x, e in zip(_numbers(leaves, "<i4"), at)]
                more = [int(x[e]) for x, e in zip(_numbers(begun, "<i8"), at)]
                sums = base.to_numpy(zero_copy_only=False) + np.array(more, dtype=np.int64)
                numbers = block.to_numpy(zero_copy_only=False) + span
                columns = [group, pa.array(numbers), pa.array(to, pa.int32()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["group", "block", "entry", "base"])

        return run

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, begun = [], []
            for l, b, l2, b2 in zip(*(_numbers(batch.column(i), "<i4" if i % 2 == 0 else "<i8") for i in (2, 3, 4, 5))):
                leaves.append(l2[l].tobytes())
                begun.append((b + b2[l]).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(leaves, pa.binary()), pa.array(begun, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "block", "leaves", "begun"])

    most = blocks.agg(F.max("block")).first()[0] or 0
    known = blocks.where("block = 0").select("group", "block", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("base"))
    exists = blocks.select("group", "block")
    span = 1
    while span <= most:
        further = known.join(blocks, ["group", "block"]).mapInArrow(ahead(span), reached).join(exists, ["group", "block"], "left_semi")
        known = stored(known.union(further), "entries")
        span *= 2
        if span <= most:
            behind = blocks.select("group", (F.col("block") - span // 2).alias("block"), F.col("leaves").alias("l2"), F.col("begun").alias("b2"))
            blocks = stored(blocks.join(behind, ["group", "block"]).mapInArrow(composed, steps), "steps")
    return known


def token_budget_batches(
    chunks: DataFrame,
    max_chunks: int,
    max_tokens: int,
    buckets: int = BUCKETS,
    by: str = "namespace",
    bucket_key: str = "file_path",
    order: tuple[str, ...] = ("file_path", "start_pos"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy batches within both limits over the whole of each namespace; only its last batch may be short.

    A chunk over the token limit is alone in its batch. Chunks are numbered first, and each block of numbers
    finds by running sums where a batch ends that begins at any of its chunks, and so, for each place where its first
    batch may begin, where that of the next block does. Composing these steps in doubling spans gives the
    true first batch of every block, and the blocks are cut independently of each other.
    """
    block_rows = max(block_rows, max_chunks)
    rows = stored(
        with_running_totals(chunks, [by], bucket_of(F.col(bucket_key), buckets), list(order), {"_rn": F.lit(1)}).withColumn("_rn", F.col("_rn") - 1),
        "numbered",
    )
    block = F.floor(F.col("_rn") / block_rows).cast("long")
    # A batch may run on into the next block, by less than its limit of chunks.
    both = F.when((F.col("_rn") % block_rows < max_chunks) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    narrow = rows.select(
        F.col(by).cast("string").alias("group"), F.explode(both).alias("block"), F.col("_rn").alias("i"),
        F.coalesce(F.col("num_tokens"), F.lit(0)).cast("long").alias("tokens"),
    )

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Complete blocks of sorted rows: ``(group, block, columns behind)``."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows:
                group, number = held.column(0)[0].as_py(), held.column(1)[0].as_py()
                numbers = held.column(1).to_numpy()
                end = int(np.flatnonzero(np.append(numbers != number, True))[0])
                # Blocks of two groups with one number may follow each other.
                names = held.column(0).slice(0, end).to_pylist() if end else []
                end = next((k for k in range(end) if names[k] != group), end) if names and names[-1] != group else end
                if end == held.num_rows:
                    break
                yield group, number, held.slice(0, end)
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield held.column(0)[0].as_py(), held.column(1)[0].as_py(), held

    def own_rows(part: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray, int]:
        i, tokens = part.column(2).to_numpy(), part.column(3).to_numpy()
        return i, tokens, int(np.searchsorted(i, (number + 1) * block_rows))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, number, part in by_block(batches):
            _, tokens, n = own_rows(part, number)
            leaves, begun = _steps(tokens, n, max_chunks, max_tokens)
            row = {"group": [group], "block": [number], "leaves": [leaves.astype("<i4").tobytes()], "begun": [begun.astype("<i8").tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=step_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, number, part in by_block(batches):
            i, tokens, n = own_rows(part, number)
            at, batch_no = part.column(4)[0].as_py(), part.column(5)[0].as_py()
            cuts = next_cuts(tokens, max_chunks, max_tokens)
            starts = []
            first = at
            while at < n:
                starts.append(at)
                at = int(cuts[at])
            if not starts:
                continue
            sizes = np.diff([*starts, at])
            which = np.repeat(np.arange(len(starts)), sizes)
            columns = [
                pa.array([group] * len(which), pa.string()),
                pa.array(i[first:at]),
                pa.array(batch_no + which),
                pa.array((np.arange(first, at) - np.array(starts)[which]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_group", "_i", "batch_no", "pos"])

    step_schema = pa.schema([("group", pa.string()), ("block", pa.int64()), ("leaves", pa.binary()), ("begun", pa.binary())])
    dealt = narrow.repartition("group", "block").sortWithinPartitions("group", "block", "i")
    found = stored(dealt.mapInArrow(steps, "group string, block bigint, leaves binary, begun binary"), "steps")
    entered = narrow.join(_entries(found), ["group", "block"]).select("group", "block", "i", "tokens", "entry", "base")
    ready = entered.repartition("group", "block").sortWithinPartitions("group", "block", "i")
    placed = ready.mapInArrow(cut, "_group string, _i bigint, batch_no bigint, pos int")
    same = rows[by].cast("string").eqNullSafe(placed["_group"]) & (rows["_rn"] == placed["_i"])
    joined = rows.join(placed, same).drop("_group", "_i", "_rn")
    return joined.withColumn("batch_id", F.concat_ws("/", by, F.col("batch_no").cast("string")))


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("namespace", "batch_no", "batch_id").agg(
        F.count("*").alias("n_chunks"), F.sum("num_tokens").alias("n_tokens")
    )


def rate_windows(
    batches: DataFrame,
    tokens_per_minute: int = TOKENS_PER_MINUTE,
    requests_per_minute: int = REQUESTS_PER_MINUTE,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The minute in which each batch may be sent, so that no minute exceeds either limit.

    Input has one row per batch ``(namespace, batch_no, batch_id, n_tokens)``. The limits hold for
    the account, so the totals run over all namespaces; a namespace's batches go by number.

    A batch costs its share of a minute by the stricter limit. A batch of at most half a minute goes
    to the half in which it starts, so the batches of a half fill one minute at most; a larger one
    has a minute of its own, and only one over the whole token limit exceeds it, alone.
    """
    half = tokens_per_minute * requests_per_minute // 2
    cost = F.greatest(F.col("n_tokens") * requests_per_minute, F.lit(tokens_per_minute).cast("long"))
    large = cost > half
    block = F.floor(F.col("batch_no") / BLOCK_BATCHES).cast("long") * buckets
    totals = with_running_totals(
        batches,
        [],
        block + bucket_of(F.col("namespace"), buckets),
        ["namespace", "batch_no"],
        {
            "tokens_so_far": F.col("n_tokens"),
            "requests_so_far": F.lit(1),
            "_small": F.when(large, 0).otherwise(cost),
            "_large": F.when(large, 1).otherwise(0),
        },
    )
    # A large batch takes the odd minute behind the minutes of all smaller ones before it.
    before = F.col("_small") - F.when(large, 0).otherwise(cost)
    minute = (before - before % half) / half + 2 * F.col("_large") - F.when(large, 1).otherwise(0)
    return totals.withColumn("minute", minute.cast("long")).drop("_small", "_large")
