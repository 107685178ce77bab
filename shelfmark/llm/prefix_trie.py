"""Trie of the conversations of a table: which of them begin with the same turns, and what that saves.

A conversation is a path of turn digests. Distinct paths are sorted, and the links between sorted
neighbours, each as deep as the turns they share, are joined in descending depth by union-find: two
components that meet make a branching node, and all depths between two meetings are a chain with
the same members. That is done for blocks of neighbours inside the tasks. Nodes that touch an end of
their block are contracted to one partial row each; the links over block borders tell what two
blocks counted twice, and the partial rows of a node are added up. Only digests and sizes of turns
are moved, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .groups import ranges

#: Bytes of a turn's digest and of a node's key.
DIGEST = 16
#: Sequences whose forest is built at a time.
BLOCK = 50_000
#: Bytes of joined ids that make one piece of a long list.
PIECE_BYTES = 1_000_000
#: Conversations borrow their first turns within blocks of this many ids, and fewer turns than this.
FAMILY, BORROWED = 5, 9

#: The digest of a node at which no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)`` of every conversation of ``conversations(conv_id, turn, role, text, …)``.

    The first h turns come from conversation ``conv_id - conv_id % 5``, the others are its own behind its
    first h; h is the CRC-32 of the decimal id modulo 9. ``path`` has 16 bytes of SHA-256 of role and
    text for each turn, ``sizes`` the UTF-8 bytes of the texts. Turns are in order of ``turn``, null first, equal ones in
    order of their digests. Null roles and texts are empty; rows without ``conv_id`` belong to no
    conversation. A conversation's digests are held in one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    one = conversations.where(F.col("conv_id").isNotNull()).select(turn.alias("t"))
    family = F.col("t.conv") - F.col("t.conv") % FAMILY
    together = one.groupBy(family.alias("base")).agg(F.sort_array(F.collect_list("t")).alias("all"))
    each = together.select("base", "all", F.explode(F.array_distinct(F.transform("all", lambda t: t["conv"]))).alias("conv_id"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    lent = F.slice(F.filter("all", lambda t: t["conv"] == F.col("base")), F.lit(1), h)
    kept = F.slice(F.filter("all", lambda t: t["conv"] == F.col("conv_id")), h + 1, F.greatest(F.size("all"), F.lit(1)))
    turns = F.concat(lent, kept)
    return each.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """``(path, sizes, n, least, ends)`` of the distinct paths of ``sequences(conv_id, path, sizes)``.

    ``n`` conversations have the path, ``least`` is the smallest of their ids and ``ends`` the SHA-256 of all of
    them, ascending and joined by commas. Ids are sorted over all tasks; a path whose ids lie in
    several goes on as pieces of joined ids, which are hashed in order as a stream.
    """
    ids = sequences.select(F.substring(F.sha2("path", 256), 1, 2 * DIGEST).alias("key"), "conv_id")
    schema = "key string, least bigint, n bigint, ends string, piece binary"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, n, parts, held, first = None, None, 0, [], 0, True
        whole: list[tuple] = []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": key, "least": least, "n": n, "ends": None, "piece": ",".join(parts).encode()}], _arrow(schema))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            numbers = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    if first and n:  # the beginning of the task may go on from the one before
                        yield piece()
                        first = False
                    elif n:
                        whole.append((key, least, n, hashlib.sha256(",".join(parts).encode()).hexdigest(), None))
                    key, least, n, parts, held = keys[a], None, 0, [], 0
                for low in range(a, b, PIECE_BYTES // 20):
                    some = numbers[low : min(b, low + PIECE_BYTES // 20)]
                    if held > PIECE_BYTES:
                        # Too long to be held: everything but the end of it goes out as it is.
                        yield piece()
                        first, least, n, parts, held = True, None, 0, [], 0
                    least = int(some[0]) if least is None else least
                    n += len(some)
                    text = ",".join(map(str, some.tolist()))
                    parts.append(text)
                    held += len(text)
            if whole:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "least", "n", "ends", "piece"), w)) for w in whole], _arrow(schema))
                whole = []
        if n:
            yield piece()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, n, digest = None, None, 0, None
        for batch in batches:
            out = []
            for k, low, count, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if n:
                        out.append({"key": key, "least": least, "n": n, "ends": digest.hexdigest()})
                    key, least, n, digest = k, low, 0, hashlib.sha256()
                elif n:
                    digest.update(b",")
                digest.update(text)
                n += count
            if out:
                yield pa.RecordBatch.from_pylist(out, _arrow(short))
        if n:
            yield pa.RecordBatch.from_pylist([{"key": key, "least": least, "n": n, "ends": digest.hexdigest()}], _arrow(short))

    short = "key string, least bigint, n bigint, ends string"
    found = stored(ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(runs, schema), "trie-ends")
    pieces = found.where("ends IS NULL").select("key", "least", "n", "piece")
    joined = pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(chained, short)
    ends = found.where("ends IS NOT NULL").select("key", "least", "n", "ends").union(joined)
    return ends.select(F.col("least").alias("conv_id"), "n", "ends").join(sequences, "conv_id").select(
        "path", "sizes", "n", F.col("conv_id").alias("least"), "ends"
    )


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(),
        "array<bigint>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def shared_turns(a: bytes, b: bytes) -> int:
    """The number of turns that two paths have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """The nodes of sorted distinct paths, as chains: depths ``low + 1`` to ``high`` of the paths from ``lo`` to ``hi``."""

    FIELDS = ("low", "high", "lo", "hi", "n", "least", "leaves", "children", "inner", "node", "parent")

    def __init__(self, shared: list[int], depth: list[int], n: list[int], least: list[int], total):
        """``shared[i]`` turns are common to paths i - 1 and i; ``total(i, d)`` are the bytes of the first d turns of path i."""
        size = len(depth)
        self.chains: list[tuple] = []
        self.alias: list[int] = list(range(size))
        self.total = total
        root = list(range(size))
        # What is known of the component whose root is i; its node is at depth ``high``.
        self.state = [[d, i, i, n[i], least[i], 1, 0, 0, i] for i, d in enumerate(depth)]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in sorted(range(1, size), key=lambda i: -shared[i]):
            d = shared[i]
            x, y = find(i - 1), find(i)
            a, b = self.state[x], self.state[y]
            nodes = [s[8] for s in (a, b) if s[0] == d]
            if nodes:
                node = nodes[0]
                for other in nodes[1:]:
                    self.alias[other] = node
            else:
                node = len(self.alias)
                self.alias.append(node)
            self._rise(a, d, node)
            self._rise(b, d, node)
            root[y] = x
            self.state[x] = [d, a[1], b[2], a[3] + b[3], min(a[4], b[4]), a[5] + b[5], a[6] + b[6], a[7] + b[7], node]
        if size:
            self._rise(self.state[find(0)], -1, -1)

    def _rise(self, state: list, d: int, node: int) -> None:
        """Make the component a part of ``node`` at depth ``d``."""
        high, lo, hi, n, least, leaves, children, inner, own = state
        if high > d:
            self.chains.append((d, high, lo, hi, n, least, leaves, children, inner, own, node))
            state[6] = 1
            state[7] = inner + (n - 1) * (self.total(lo, high) - self.total(lo, max(d, 0)))
        elif not children:
            state[5] = 0  # the path ends where the other one goes on

    def columns(self) -> dict[str, np.ndarray]:
        """The chains as arrays; ``node`` and ``parent`` are numbers of chains, the parent of the last is -1."""
        table = dict(zip(self.FIELDS, np.array(self.chains, dtype=np.int64).reshape(-1, len(self.FIELDS)).T))
        alias = np.array(self.alias, dtype=np.int64)
        while len(alias) and not np.array_equal(alias, alias[alias]):
            alias = alias[alias]
        chain = np.full(len(alias) + 1, -1, dtype=np.int64)
        chain[alias[table["node"]]] = np.arange(len(self.chains))
        table["parent"] = np.where(table["parent"] >= 0, chain[alias[table["parent"]]], -1)
        return table


NODES = (
    "block string, key string, parent_key string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string, open boolean, last boolean, above bigint, first_path binary, last_path binary, last_totals array<bigint>"
)


def _block(paths: list[bytes], sizes: list[list[int]], n: list[int], least: list[int], ends: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one block of sorted distinct paths: its nodes and one row on its ends."""
    k = len(paths)
    depth = [len(p) // DIGEST for p in paths]
    shared = [-1] + [shared_turns(a, b) for a, b in zip(paths, paths[1:])]
    start = np.concatenate([[0], np.cumsum([d + 1 for d in depth])])
    flat = np.concatenate([np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes]).astype(np.int64)
    at, totals = start.tolist(), flat.tolist()
    chains = Forest(shared, depth, n, least, lambda i, d: totals[at[i] + d]).columns()

    # Each path begins the nodes that are deeper than what it shares with the path before.
    keys: list[bytes] = []
    stack: list[bytes] = []
    for path, known, d in zip(paths, shared, depth):
        del stack[known + 1 :]
        for e in range(known + 1, d + 1):
            stack.append(hashlib.sha256(stack[-1] + path[(e - 1) * DIGEST : e * DIGEST]).digest()[:DIGEST] if e else b"")
            keys.append(stack[-1])
    # Where the key of depth 0 of each path would be.
    base = np.concatenate([[0], np.cumsum(np.array(depth) - np.array(shared))])[:-1] - (np.array(shared) + 1)

    names = pa.array([key.hex() for key in keys], pa.string())
    low, high, parent = chains["low"], chains["high"], chains["parent"]
    row = np.repeat(np.arange(len(low)), high - low)
    d = ranges(low + 1, high + 1)
    lo, hi, count = chains["lo"][row], chains["hi"][row], chains["n"][row]
    is_open = (chains["lo"] == 0) | (chains["hi"] == k - 1)
    top = d == low[row] + 1
    deepest = d == high[row]
    outer = parent[row]
    above = flat[start[lo] + np.maximum(d - 1, 0)]
    holder = np.where(top & (outer >= 0), chains["lo"][outer], lo)
    known_parent = np.where(top, np.where(outer >= 0, chains["least"][outer], 0), chains["least"][row])
    no_parent = d == 0
    unknown = no_parent | is_open[row] | (top & (outer >= 0) & is_open[outer])
    parent_at = np.where(no_parent, 0, base[holder] + d - 1)
    block = hashlib.sha256(paths[0]).hexdigest()[: 2 * DIGEST]
    # A path that ends at a node is the first of the node's paths.
    ending = deepest & (np.array(depth)[lo] == d)
    ends_at = pa.array(np.where(ending, lo, 0), mask=~ending)
    columns = {
        "block": pa.array([block] * len(d), pa.string()),
        "key": names.take(pa.array(base[lo] + d)),
        "parent_key": names.take(pa.array(parent_at, mask=no_parent)),
        "depth": pa.array(d),
        "conv_id": pa.array(chains["least"][row]),
        "parent_conv_id": pa.array(known_parent, mask=unknown),
        "n_convs": pa.array(count),
        "n_children": pa.array(np.where(deepest, chains["children"][row], 1)),
        "n_leaves": pa.array(chains["leaves"][row]),
        "saved_tokens": pa.array(chains["inner"][row] + (count - 1) * (flat[start[lo] + high[row]] - above)),
        "ends": pa.array(ends, pa.string()).take(ends_at),
        "open": pa.array(is_open[row]),
        "last": pa.array(hi == k - 1),
        "above": pa.array(above),
    }
    schema = _arrow(NODES)
    for field in schema:
        columns.setdefault(field.name, pa.nulls(len(d), field.type))
    yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
    border = {"block": block, "first_path": paths[0], "last_path": paths[-1], "last_totals": flat[start[k - 1] : start[k]].tolist()}
    yield pa.RecordBatch.from_pylist([border], schema)


def prefix_trie(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, parent_key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends)`` for every
    node of the trie of ``paths(path, sizes, n, least, ends)``, whose paths are distinct.

    ``ends`` is that of the path that ends at the node, else null; sums are over the node's subtree. No
    paths give no nodes; the empty path gives the root. ``block`` paths are worked on at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for column, values in zip(held, batch.columns):
                column.extend(values.to_pylist())
            while len(held[0]) >= block:
                yield from _block(*(column[:block] for column in held))
                held = [column[block:] for column in held]
        if held[0]:
            yield from _block(*held)

    dealt = paths.select("path", "sizes", "n", "least", "ends").repartitionByRange("path").sortWithinPartitions("path")
    found = stored(dealt.mapInArrow(run, NODES), "trie-nodes")

    # What the paths on both sides of each border share. One row a block.
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, last, after, totals in zip(*(c.to_pylist() for c in batch.columns)):
                both = -1 if after is None else shared_turns(last, after)
                rows.append({"block": b, "both": both, "both_bytes": totals[max(both, 0)], "extended": both == len(last) // DIGEST})
            yield pa.RecordBatch.from_pylist(rows, _arrow(border))

    border = "block string, both bigint, both_bytes bigint, extended boolean"
    ends = found.where("first_path IS NOT NULL")
    after = ends.select("block", "last_path", F.lead("first_path").over(Window.orderBy("first_path")).alias("after"), "last_totals")
    borders = after.mapInArrow(meet, border)

    partial = found.where("open").join(borders, "block")
    crosses = F.col("last") & (F.col("depth") <= F.col("both"))
    twice = lambda condition, value: F.when(crosses & condition, value).otherwise(0)
    merged = stored(
        partial.groupBy("key", "depth").agg(
            F.min("parent_key").alias("parent_key"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum(F.col("n_children") - twice(F.col("both") > F.col("depth"), F.lit(1))).alias("n_children"),
            F.sum(F.col("n_leaves") - twice(F.col("extended"), F.lit(1))).alias("n_leaves"),
            F.sum(F.col("saved_tokens") + twice(F.lit(True), F.col("both_bytes") - F.col("above"))).alias("saved_tokens"),
            F.max("ends").alias("ends"),
        ),
        "trie-merged",
    )
    names = ["key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.join(parents, "parent_key", "left").select(names)
    closed = found.where("NOT open")
    # Below a merged node: its id by block and key, so that many children of one node do not meet in a task.
    hung = closed.where("parent_conv_id IS NULL").drop("parent_conv_id")
    own = found.where("open").select("block", F.col("key").alias("parent_key")).join(parents, "parent_key")
    return upper.union(hung.join(own, ["block", "parent_key"]).select(names)).union(closed.where("parent_conv_id IS NOT NULL").select(names))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations; see :func:`rebuilt` and :func:`prefix_trie`.

    ``ends_sha256`` is the SHA-256 of the ids of the conversations that end at a node. An empty table
    gives no nodes; repeated rows are repeated turns; other columns are ignored whatever their names.
    """
    sequences = stored(rebuilt(conversations), "trie-paths")
    nodes = prefix_trie(distinct_paths(sequences))
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")
