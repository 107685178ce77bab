"""Exact nearest neighbours as blocked matrix products.

Similarities are never written out as pairs: a task multiplies a block of vectors with the
queries and keeps k candidates per query, and only those are shuffled and ranked. Vectors of a block lie near
each other, as do queries of a group, and by its mean and radius a block is passed over that cannot hold anything better than what a
query has; bounds are exact, so the rows are those of a comparison with all. Rows whose vector holds null or
values that are not finite have no similarity to anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import top_k

METRICS = ("cosine", "dot", "l2")
#: The query matrix is broadcast up to this size; beyond it queries and corpus are cut into blocks.
QUERY_BYTES = 64 << 20
CORPUS_BLOCK_ROWS = 200_000
#: Groups of blocks for each core, as long as there are so many blocks.
GROUPS_PER_CORE = 4
#: Rows that are gathered in a task before they are dealt to blocks, blocks they are dealt to, and rows from which on they are dealt.
GATHERED_ROWS, PIVOTS, PRUNED_ROWS = 65_536, 64, 1_024
#: Queries of a group, at most.
GROUP_ROWS = 1_024
#: What bounds may be short of by rounding; it is more than the digits that scores are ranked by.
MARGIN = 1e-9
#: A squared distance below this share of the squared norms is taken from the differences, as too few digits are left of it.
_CANCELS = 1e-3
#: Products held at a time, differences held at a time.
_TILE, _PAIRS = 1_000_000, 65_536
#: Digits behind the point that scores are ranked by: sums of products differ behind these with the order of
#: their terms, so rows that are equal up to there are ties.
_DIGITS = 1e12


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _with_vector(rows):
    """Rows whose vector is not null. Dropped here and not by a filter in front, which would
    compute an embedding expression once more."""
    return rows.filter(rows.column("embedding").is_valid())


def _finite(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.isfinite(vectors).all(axis=1)
    return (ids, vectors) if keep.all() else (ids[keep], vectors[keep])


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k highest scores, of equal ones the first, in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    limit = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    kept = scores >= limit
    if kept.sum() > k * len(scores):
        tied = scores == limit
        kept &= ~tied | (np.cumsum(tied, axis=1) <= k - (kept & ~tied).sum(axis=1, keepdims=True))
    return np.nonzero(kept)[1].reshape(len(scores), k)


class _Block:
    """Vectors around their mean: how near any of them can be to a query is bounded without looking at them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.squares = (self.vectors**2).sum(axis=1)
        self.center = vectors.mean(axis=0)
        self.radius = float(np.sqrt(((vectors - self.center) ** 2).sum(axis=1).max()))

    def bound(self, queries: np.ndarray, norms: np.ndarray, metric: str) -> np.ndarray:
        """No vector of the block is more similar than this to each query. ``queries`` are unit vectors for cosine."""
        if metric == "dot":
            return queries @ self.center + norms * self.radius
        away = np.maximum(np.sqrt(((queries - self.center) ** 2).sum(axis=1)) - self.radius, 0)
        return -away if metric == "l2" else 1 - away**2 / 2


def _dealt(vectors: np.ndarray, pivots: int) -> list[np.ndarray]:
    """Row numbers dealt to the nearest of some rows."""
    some = vectors[:: max(1, len(vectors) // pivots)][:pivots]
    nearest_pivot = np.argmax(vectors @ some.T - (some**2).sum(axis=1) / 2, axis=1)
    order = np.argsort(nearest_pivot, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(nearest_pivot[order])) + 1)


def _blocks(ids: np.ndarray, vectors: np.ndarray) -> list[_Block]:
    if len(ids) < PRUNED_ROWS:
        return [_Block(ids, vectors)]
    return [_Block(ids[rows], vectors[rows]) for rows in _dealt(vectors, PIVOTS)]


class _Group:
    """Queries and the k best ``(score, id)`` of each seen so far; ties by smaller id. ``queries`` are unit vectors for cosine."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.metric, self.exclude_self = metric, exclude_self
        self.squares = (queries**2).sum(axis=1)
        self.norms = np.sqrt(self.squares)
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids: np.ndarray | None = None

    def _similarities(self, of: np.ndarray, block: _Block, at: slice, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries of ``of`` that a row of the block may serve, and their scores, to ``_DIGITS``: higher is nearer,
        distances are negated."""
        queries = self.queries if len(of) == len(self.queries) else self.queries[of]
        scores = queries @ block.vectors[at].T
        if self.metric != "l2":
            may = scores.max(axis=1) + MARGIN >= limit
            of, scores = of[may], scores[may]
        else:
            size = self.squares[of][:, None] + block.squares[at][None, :]
            scores *= -2
            scores += size
            np.maximum(scores, 0, out=scores)
            # The k-th best as a square, and what squares may be wrong by.
            reach = (MARGIN - limit) ** 2 + _CANCELS * MARGIN * size.max(axis=1)
            may = scores.min(axis=1) <= reach
            of, scores, size, reach = of[may], scores[may], size[may], reach[may]
            row, column = np.nonzero((scores < _CANCELS * size) & (scores <= reach[:, None]))
            for i in range(0, len(row), _PAIRS):
                r, c = row[i : i + _PAIRS], column[i : i + _PAIRS]
                scores[r, c] = ((self.queries[of[r]] - block.vectors[at][c]) ** 2).sum(axis=1)
            np.sqrt(scores, out=scores)
            np.negative(scores, out=scores)
        scores *= _DIGITS
        np.rint(scores, out=scores)
        scores /= _DIGITS
        return of, scores

    def add(self, block: _Block, of: np.ndarray) -> None:
        """Look at the rows of a block for some of the queries."""
        step = max(self.k + 1, _TILE // max(1, len(of)))
        for start in range(0, len(block.ids), step):
            at = slice(start, start + step)
            some, scores = self._similarities(of, block, at, self.scores[of, -1])
            if not len(some):
                continue
            ids = block.ids[at]
            if self.exclude_self:
                own = np.flatnonzero(np.isin(self.query_ids[some], ids))
                scores[own] = np.where(self.query_ids[some[own], None] == ids[None, :], -np.inf, scores[own])
            best = _first_best(scores, self.k)
            self._keep(some, np.take_along_axis(scores, best, axis=1), ids[best])

    def _keep(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is None:  # any id does where there is none, as its score is -inf
            self.ids = np.full(self.scores.shape, ids[0, 0])
        ids, scores = np.hstack([self.ids[of], ids]), np.hstack([self.scores[of], scores])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        kept = np.take_along_axis(ids, order, axis=1)
        if kept.dtype != self.ids.dtype:  # longer strings
            self.ids = self.ids.astype(np.promote_types(kept.dtype, self.ids.dtype))
        self.scores[of], self.ids[of] = np.take_along_axis(scores, order, axis=1), kept


class _BestK:
    """The k best ``(score, id)`` of each query, in groups of queries near each other. Counts the blocks the groups met and passed over."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.metric = metric
        query_ids, queries = _finite(query_ids, queries)
        if metric == "cosine":
            queries = _unit(queries)
        dealt = [np.arange(len(queries))] if len(queries) <= GROUP_ROWS else _dealt(queries, -(-2 * len(queries) // GROUP_ROWS))
        cut = [rows[at : at + GROUP_ROWS] for rows in dealt for at in range(0, len(rows), GROUP_ROWS)]
        self.groups = [_Group(query_ids[rows], queries[rows], k, metric, exclude_self) for rows in cut]
        self.met = self.passed = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Look at rows: many at a time in blocks of near ones, for each group those first that promise most. A block that cannot
        hold anything better than the k best of any query is passed over; queries it cannot serve are left out of it."""
        ids, vectors = _finite(ids, vectors)
        if not len(ids):
            return
        parts = _blocks(ids, _unit(vectors) if self.metric == "cosine" else vectors)
        for group in self.groups:
            bounds = [part.bound(group.queries, group.norms, self.metric) for part in parts]
            for i in sorted(range(len(parts)), key=lambda i: -bounds[i].mean()):
                near = np.flatnonzero(bounds[i] + MARGIN >= group.scores[:, -1])
                self.met += 1
                if len(near):
                    group.add(parts[i], near)
                else:
                    self.passed += 1

    def table(self, schema: pa.Schema) -> pa.Table:
        """The rows found, group after group."""
        return pa.concat_tables([schema.empty_table(), *[self._rows(g, schema) for g in self.groups if g.ids is not None]])

    def _rows(self, group: _Group, schema: pa.Schema) -> pa.Table:
        keep = np.isfinite(group.scores)
        columns = [np.repeat(group.query_ids, keep.sum(1)), group.ids[keep], group.scores[keep]]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_pylist()) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return pa.int64()
    if isinstance(kind, T.IntegerType):
        return pa.int32()
    if isinstance(kind, T.StringType):
        return pa.string()
    raise TypeError(f"ids must be long, int or string, not {kind.simpleString()}")


def _near_schema(corpus: DataFrame, queries: DataFrame) -> tuple[T.StructType, pa.Schema]:
    q, d = queries.schema["query_id"].dataType, corpus.schema["doc_id"].dataType
    spark_schema = T.StructType(
        [T.StructField("query_id", q), T.StructField("doc_id", d), T.StructField("score", T.DoubleType())]
    )
    arrow_schema = pa.schema(
        [
            ("query_id", _arrow_type(queries, "query_id")),
            ("doc_id", _arrow_type(corpus, "doc_id")),
            ("score", pa.float64()),
        ]
    )
    return spark_schema, arrow_schema


def _by_broadcast(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool, report: bool = False
) -> DataFrame:
    spark_schema, arrow_schema = _near_schema(corpus, queries)
    table = _with_vector(queries.toArrow())
    if table.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], spark_schema)
    shared = corpus.sparkSession.sparkContext.broadcast((_ids(table["query_id"]), _matrix(table["embedding"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _BestK(*shared.value, k, metric, exclude_self)
        for ids, vectors in _gathered(batches):
            best.add(ids, vectors)
        if report:
            counts = {"blocks": [best.met], "passed": [best.passed]}
            yield pa.RecordBatch.from_pydict(counts, schema=pa.schema([("blocks", pa.int64()), ("passed", pa.int64())]))
        else:
            yield from best.table(arrow_schema).to_batches(max_chunksize=10_000)

    return corpus.mapInArrow(search, "blocks long, passed long" if report else spark_schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with vectors, some batches together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in map(_with_vector, batches):
        if batch.num_rows:
            held.append((_ids(batch.column("doc_id")), _matrix(batch.column("embedding"))))
        if sum(len(i) for i, _ in held) >= GATHERED_ROWS:
            yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            held = []
    if held:
        yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])


def _by_blocks(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool, nq: int, nc: int
) -> DataFrame:
    """Every block of queries meets every block of the corpus in a group of its own.

    Blocks are hashes of ids, hence even; a group holds one block of each side.
    """
    spark_schema, arrow_schema = _near_schema(corpus, queries)
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block("query_id", nq)).withColumn("cb", all_of(nc))
    right = corpus.withColumn("cb", block("doc_id", nc)).withColumn("qb", all_of(nq))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        q = _with_vector(q)
        if not q.num_rows or not c.num_rows:
            return arrow_schema.empty_table()
        best = _BestK(_ids(q["query_id"]), _matrix(q["embedding"]), k, metric, exclude_self)
        for ids, vectors in _gathered(c.to_batches()):
            best.add(ids, vectors)
        return best.table(arrow_schema)

    return (
        left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, spark_schema)
    )


def block_counts(total_bytes: int, rows: int, query_bytes: int, block_rows: int, cores: int) -> tuple[int, int]:
    """How many blocks queries of ``total_bytes`` and a corpus of ``rows`` are cut into.

    Every block is sent once for each block of the other side, so their number is kept low: blocks of ``query_bytes``
    and ``block_rows`` are put together up to ``QUERY_BYTES`` and ``CORPUS_BLOCK_ROWS``, as long as all cores have groups.
    """
    enough = math.isqrt(GROUPS_PER_CORE * cores) + 1
    count = lambda size, least, most: max(1, min(-(-size // least), max(enough, -(-size // most))))
    return count(total_bytes, query_bytes, QUERY_BYTES), count(rows, block_rows, CORPUS_BLOCK_ROWS)


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = False,
    query_bytes: int = QUERY_BYTES,
    block_rows: int = CORPUS_BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the k nearest rows of ``corpus`` to each query.

    ``corpus`` is ``(doc_id, embedding)``, ``queries`` is ``(query_id, embedding)``. The
    queries are measured; up to ``query_bytes`` they are broadcast and the corpus is read
    in place, beyond that both sides are cut into blocks (see ``block_counts``). ``l2`` scores are distances.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    corpus = corpus.select("doc_id", "embedding")
    queries = queries.select("query_id", "embedding")
    total = queries.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    if 8 * total <= query_bytes:
        found = _by_broadcast(corpus, queries, k, metric, exclude_self)
    else:
        cores = corpus.sparkSession.sparkContext.defaultParallelism
        found = _by_blocks(corpus, queries, k, metric, exclude_self, *block_counts(8 * total, corpus.count(), query_bytes, block_rows, cores))
    ranked = top_k(found, k)
    return ranked.withColumn("score", -F.col("score")) if metric == "l2" else ranked


def pruning(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(blocks, passed)`` per task of a search: how many blocks of rows there were, and how many were passed over."""
    return _by_broadcast(corpus.select("doc_id", "embedding"), queries.select("query_id", "embedding"), k, metric, False, True)


def topk_cosine(corpus: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return nearest(corpus, queries, k, "cosine", **options)


def topk_dot(corpus: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return nearest(corpus, queries, k, "dot", **options)


def topk_l2(corpus: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return nearest(corpus, queries, k, "l2", **options)
