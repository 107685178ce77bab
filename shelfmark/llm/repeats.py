"""Removal of long repeated byte strings with a sparse enhanced suffix array.

Every string of ``LENGTH`` bytes holds at least one *anchor*, a seed of ``SEED`` bytes whose hash is
the least of all seeds in the string; which ones these are depends on the string alone, so equal
strings have the same anchors at the same places. Only the suffixes that begin at anchors are
sorted, about one position in 130, and only those whose seed occurs more than once.

The suffixes that share a seed are sorted, a scan with a stack gives the intervals of their common
prefixes, and within each interval the texts to the left of the anchors are sorted and scanned the
same way, backwards. An interval of the left scan is a maximal repeat, together with all its occurrences, when
its members go on differently on both sides: left, as it is an interval there, and right, as they
belong to more than one child of the interval on the right. A repeat that spans an anchor reaches
at most ``LENGTH - SEED`` bytes before it and ``LENGTH`` behind its beginning in what is
needed here, as every removed byte lies in a window of ``LENGTH`` bytes.

Texts that are equal as a whole are settled by their digest, one of them stands for all. Occurrences with
the same bytes all around are one context, wherever they stand; only distinct contexts are sorted, and what is
found for one goes back to all its places by a join. A seed with very many contexts is cut into tiles (see
``groups``): every two of them meet in some tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import utf8
from .groups import PART_ROWS, large_keys, scan_groups, tiled
from .line_dedup import mixed

LENGTH = 400
SEED = 128
#: Bytes of a text that are searched for anchors at a time.
CHUNK = 1 << 20
#: One in so many contexts is used to estimate which seeds are crowded.
SAMPLE = 32
#: Contexts with more than one in so many of all occurrences are sent to all tasks; there are at most this many.
PARTS = 4096
#: Contexts that are gathered in a task at a time, besides those of one seed.
GATHERED = 40_000
#: Contexts of a seed that are compared with each other rather than sorted.
FEW = 24
#: Contexts that a task remembers to have sent.
REMEMBERED = 500_000

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_FULL = np.uint64(2**64 - 1)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)


def seeds_of(data: np.ndarray) -> np.ndarray:
    """Hashes of all seeds of some bytes, by running sums of powers."""
    global _UP, _DOWN
    if len(_UP) < len(data):
        _UP, _DOWN = _powers(_BASE, max(4096, len(data))), _powers(_UNBASE, max(4096, len(data)))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    return mixed((total[SEED:] - total[:-SEED]) * _DOWN[: len(data) - SEED + 1])


def _sliding(x: np.ndarray, width: int, of: np.ufunc, empty: np.uint64) -> np.ndarray:
    """``of`` over every run of ``width`` values, from running values within blocks of that size."""
    n = -(-len(x) // width) * width
    blocks = np.full(n, empty, dtype=np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(position, seed)`` of all anchors of some bytes, in order; none in fewer than ``LENGTH`` bytes."""
    width = LENGTH - SEED + 1
    places, hashes = [], []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        own = seeds_of(data[at : at + CHUNK + LENGTH - 1])
        least = _sliding(own, width, np.minimum, _FULL)
        edge = np.zeros(width - 1, dtype=np.uint64)
        # A seed is an anchor when it equals the least of a string that holds it: the greatest of those that do.
        greatest = _sliding(np.concatenate([edge, least, edge]), width, np.maximum, np.uint64(0))
        found = np.flatnonzero(greatest == own)
        places.append(found + at)
        hashes.append(own[found].view(np.int64))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first ``low`` bytes agree, the first ``high`` do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(first, last, length)`` of the common-prefix intervals of sorted strings, by a scan with a stack.

    ``lcp[k]`` is what strings ``k`` and ``k + 1`` share.
    """
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][1] > length:
            first, longer = stack.pop()
            yield first, k, longer
        if length >= 0 and (not stack or stack[-1][1] < length):
            stack.append((first, length))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """``(before, behind, occurrences)`` of the maximal repeats through an anchor.

    ``left`` has the bytes before each occurrence of the anchor, backwards, ``right`` those from it on.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    shared = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    for first, last, behind in intervals(shared):
        if behind + max(map(len, left)) < least:
            continue
        child, children = 0, {order[first]: 0}
        for k in range(first, last):
            child += shared[k] == behind
            children[order[k + 1]] = child
        members = sorted(children, key=left.__getitem__)
        before = [common(left[a], left[b]) for a, b in zip(members, members[1:])]
        for a, b, length in intervals(before):
            if length + behind >= least:
                group = members[a : b + 1]
                if len({children[m] for m in group}) > 1:
                    yield length, behind, group


def _table(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as the rows of an array, and their lengths."""
    data = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), dtype=np.uint8).reshape(len(rows), width)
    return data, np.array([len(r) for r in rows])


def _agreeing(equal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How long strings agree, given where they do along the last axis and how long both are."""
    first = np.argmin(equal, axis=-1)
    return np.minimum(np.where(np.take_along_axis(equal, first[..., None], -1)[..., 0], equal.shape[-1], first), lengths)


def _neighbours(data: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """What each string shares with the next one in an order."""
    own, size = data[order], lengths[order]
    return _agreeing(own[1:] == own[:-1], np.minimum(size[1:], size[:-1]))


class _Least:
    """The least of any range of some values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For ranges ``[low, high)`` that are not empty."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            out[here] = np.minimum(self.levels[k][low[here]], self.levels[k][high[here] - (1 << k)])
        return out


def reach(left: list[bytes], right: list[bytes], copies: list[bool], least: int = LENGTH) -> list[tuple[int, int]]:
    """How far each occurrence is covered before and behind its anchor by repeats of at least ``least`` bytes.

    All repeats of an occurrence hold its anchor, so together they are one run. ``copies`` tells
    which occurrences stand more than once with the same bytes all around. The intervals of all common
    prefixes of one length are scanned together, the longest first: within each, the neighbours in order of
    the bytes to the left share the most with an occurrence, and the shortest stretch between two in that
    order tells how much. Occurrences that are few are compared with each other.
    """
    n = len(left)
    own_left = np.array([len(x) for x in left])
    own_right = np.array([len(x) for x in right])
    whole = np.array(copies) & (own_left + own_right >= least)
    before, behind = np.where(whole, own_left, 0), np.where(whole, own_right, 0)
    if n > 1:
        widths = max(1, own_left.max()), max(1, own_right.max())
        lefts, rights = _table(left, widths[0])[0], _table(right, widths[1])[0]
        if n <= FEW:
            x = _agreeing(lefts[:, None] == lefts[None], np.minimum(own_left[:, None], own_left[None]))
            y = _agreeing(rights[:, None] == rights[None], np.minimum(own_right[:, None], own_right[None]))
            far = (x + y >= least) & ~np.eye(n, dtype=bool)
            before = np.maximum(before, np.where(far, x, 0).max(axis=1))
            behind = np.maximum(behind, np.where(far, y, 0).max(axis=1))
        else:
            _scan(left, right, lefts, rights, own_left, own_right, before, behind, least)
    return list(zip(before.tolist(), behind.tolist()))


def _scan(left, right, lefts, rights, own_left, own_right, before, behind, least) -> None:
    n = len(left)
    by_right = np.array(sorted(range(n), key=right.__getitem__))
    by_left = np.array(sorted(range(n), key=left.__getitem__))
    shared = _neighbours(rights, own_right, by_right)
    between = _Least(_neighbours(lefts, own_left, by_left))
    rank = np.empty(n, dtype=np.int64)
    rank[by_left] = np.arange(n)
    for length in np.unique(shared)[::-1].tolist():
        if length + own_left.max() < least:
            break
        linked = shared >= length
        inside = np.zeros(n, dtype=bool)
        inside[1:] |= linked
        inside[:-1] |= linked
        interval = np.concatenate([[0], np.cumsum(~linked)])[inside]
        some = by_right[inside]
        order = np.argsort(interval * n + rank[some])
        some, interval = some[order], interval[order]
        pair = np.flatnonzero(interval[1:] == interval[:-1])
        x = np.zeros(len(some), dtype=np.int64)
        most = between.of(rank[some[pair]], rank[some[pair + 1]])
        x[pair] = most
        x[pair + 1] = np.maximum(x[pair + 1], most)
        far = x + length >= least
        some, x = some[far], x[far]
        before[some] = np.maximum(before[some], x)
        behind[some] = np.maximum(behind[some], length)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_bytes, sha256, seeds, twice)``: the distinct seeds at anchors, and whether each occurs twice in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, hashes, seeds, twice = [], [], [], [], []
            for scalar in batch.column(1).cast(pa.binary()):
                data = scalar.as_py() or b""
                full = hashlib.sha256(data)
                digests.append(full.digest()[:16])
                hashes.append(full.hexdigest())
                sizes.append(len(data))
                _, found = anchors(np.frombuffer(data, dtype=np.uint8))
                found, n = np.unique(found, return_counts=True)
                seeds.append(found)
                twice.append(n > 1)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in seeds])]), pa.int32())
            columns = [
                batch.column(0),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(hashes, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(seeds))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(twice))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_bytes", "sha256", "seeds", "twice"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, n_bytes bigint, sha256 string, seeds array<bigint>, twice array<boolean>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


_KEY = ["seed", "c1", "c2"]


def _occurrences(texts: DataFrame) -> DataFrame:
    """``(seed, c1, c2, before, behind, digest, places)`` for the anchors of ``texts(digest, text, seeds)`` whose seed is listed.

    ``c1, c2`` are the digest of the bytes around. A context is one row with its bytes, mostly once a task, and one
    with the places it has in each text.
    """
    names = [*_KEY, "before", "behind", "digest", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for digest, data, wanted in zip(batch.column(0), utf8(batch.column(1)), batch.column(2)):
                place, seed = anchors(np.frombuffer(data, dtype=np.uint8))
                keep = np.isin(seed, wanted.values.to_numpy())
                found: dict[bytes, list[int]] = {}
                of: dict[bytes, int] = {}
                bytes_of: dict[bytes, tuple[bytes, bytes]] = {}
                for p, s in zip(place[keep].tolist(), seed[keep].tolist()):
                    before, behind = data[max(0, p - LENGTH + SEED) : p], data[p : p + LENGTH]
                    key = hashlib.blake2b(len(before).to_bytes(2, "little") + before + behind, digest_size=16).digest()
                    found.setdefault(key, []).append(p)
                    of[key] = s
                    if key not in sent:
                        sent.add(key)
                        bytes_of[key] = before[::-1], behind
                if len(sent) > REMEMBERED:
                    sent = set()
                if not found:
                    continue
                for keys, own in ((list(bytes_of), True), (list(found), False)):
                    pair = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                    columns = [pa.array([of[k] for k in keys], pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                    if own:
                        columns += [pa.array([bytes_of[k][i] for k in keys], pa.binary()) for i in (0, 1)]
                        columns += [pa.nulls(len(keys), pa.binary()), pa.nulls(len(keys), pa.list_(pa.int32()))]
                    else:
                        columns += [pa.nulls(len(keys), pa.binary())] * 2
                        columns += [pa.array([digest.as_py()] * len(keys), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "seed bigint, c1 bigint, c2 bigint, before binary, behind binary, digest binary, places array<int>"
    return texts.select("digest", "text", "seeds").mapInArrow(run, schema)


class _Contexts:
    """The distinct contexts of all anchors of some texts, and their places."""

    def __init__(self, texts: DataFrame):
        found = stored(_occurrences(texts), "occurrences")
        self.places = found.where("places IS NOT NULL").select(*_KEY, "digest", "places")
        counted = found.groupBy(*_KEY).agg(
            F.first("before", ignorenulls=True).alias("before"),
            F.first("behind", ignorenulls=True).alias("behind"),
            F.sum(F.coalesce(F.size("places"), F.lit(0))).alias("n"),
        )
        self.contexts = stored(counted, "contexts")
        sampled = self.contexts.where(F.pmod("c1", F.lit(SAMPLE)) == 0).select("seed")
        self.placed = tiled(self.contexts, large_keys(sampled, "seed", SAMPLE, PART_ROWS), "seed", "c1")

    def at_places(self, found: DataFrame) -> DataFrame:
        """``found(seed, c1, c2, …)`` with ``digest`` and ``place`` of every place of the contexts."""
        total = self.contexts.agg(F.sum("n")).first()[0] or 0
        counts = self.contexts.select(*_KEY, "n").join(found, _KEY)
        counts = stored(counts, "found")
        most = max(1, total // PARTS)
        common, others = F.broadcast(counts.where(F.col("n") > most)), counts.where(F.col("n") <= most)
        joined = self.places.join(common, _KEY).unionByName(self.places.join(others, _KEY))
        return joined.withColumn("place", F.explode("places")).drop("places", "n")


def _covered(own: _Contexts) -> DataFrame:
    """``(digest, start, end)`` of the runs that repeats cover, not yet joined across anchors."""

    def work(columns, starts, ends) -> Iterator[pa.RecordBatch]:
        left, right = columns["before"].to_pylist(), columns["behind"].to_pylist()
        twice = (columns["n"] > 1).tolist()
        rows, before, behind = [], [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a == 1 and not twice[a]:
                continue
            for k, (x, y) in enumerate(reach(left[a:b], right[a:b], twice[a:b])):
                if x + y:
                    rows.append(a + k)
                    before.append(x)
                    behind.append(y)
        if rows:
            keys = [pa.array(columns[c][rows]) for c in _KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(before, pa.int64()), pa.array(behind, pa.int64())], [*_KEY, "x", "y"])

    reached = scan_groups(own.placed, "seed", [], work, "seed bigint, c1 bigint, c2 bigint, x bigint, y bigint", GATHERED)
    reached = reached.groupBy(*_KEY).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return own.at_places(reached).select("digest", (F.col("place") - F.col("x")).alias("start"), (F.col("place") + F.col("y")).alias("end"))


def _settled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scanned rows, copies, cuts)``: ``copies(digest, n, first)`` per distinct text, and
    ``cuts(digest, n_removed, n_spans, kept)`` of texts that lose bytes though no other text equals them."""
    scanned = stored(_scanned(docs), "scanned")
    copies = stored(
        scanned.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("n_bytes").alias("size")), "copies"
    )
    # One row stands for all that are equal.
    one = scanned.join(copies.select(F.col("digest").alias("_d"), "first"), (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("first")))
    each = one.select("digest", F.explode_outer(F.arrays_zip("seeds", "twice")).alias("s")).select("digest", F.col("s.seeds").alias("seed"), "s.twice")
    each = stored(each.where("seed is not null"), "seeds")
    repeated = each.groupBy("seed").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("seed")
    wanted = each.join(repeated, "seed", "left_semi").groupBy("digest").agg(F.collect_set("seed").alias("seeds"))
    wanted = wanted.join(copies, "digest").select(F.col("digest").alias("_digest"), "first", "seeds")
    here = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest(F.col("text")).alias("digest"))
    found = here.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first")))
    texts = stored(found.select("digest", "text", "seeds"), "candidates")
    # Rows that are equal with their id are one.
    texts = texts.dropDuplicates(["digest"])
    spans = _covered(_Contexts(texts)).groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = texts.join(spans, "digest").select("digest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n, kept = [], [], []
            for data, spans_here in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                gone = merged([(s["start"], s["end"]) for s in spans_here])
                ends = [0, *(b for _, b in gone)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)])))
                removed.append(sum(b - a for a, b in gone))
                n.append(len(gone))
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_removed", "n_spans", "kept"])

    cuts = cut.mapInArrow(run, "digest binary, n_removed bigint, n_spans bigint, kept binary").dropDuplicates(["digest"])
    whole = copies.where((F.col("n") > 1) & (F.col("size") >= LENGTH)).select(
        F.col("digest"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")
    )
    single = copies.where((F.col("n") == 1) | (F.col("size") < LENGTH)).select("digest")
    return scanned, copies, cuts.join(single, "digest", "left_semi").unionByName(whole)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """``(group, length, doc_id, start)``: the occurrences, in bytes, of every maximal repeat of at least ``LENGTH`` bytes.

    A repeat longer than ``LENGTH`` bytes is looked at through windows around its anchors, so it is several groups
    of windows that overlap. Groups are told by a digest of their bytes. Where a seed has more contexts than fit a tile, a
    group lists the occurrences of the tiles in which it is maximal. Texts that are equal as a whole each give their own.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest(F.col("text")).alias("digest"))
    scanned = _scanned(docs).select("digest", F.explode_outer("seeds").alias("seed")).where("seed is not null").distinct()
    wanted = scanned.groupBy("digest").agg(F.collect_set("seed").alias("seeds"))
    own = _Contexts(texts.select("digest", "text").dropDuplicates(["digest"]).join(wanted, "digest"))
    copies = texts.groupBy("digest").agg((F.count("*") > 1).alias("copied"))

    def work(columns, starts, ends) -> Iterator[pa.RecordBatch]:
        left, right = columns["before"].to_pylist(), columns["behind"].to_pylist()
        rows, groups, lengths, before = [], [], [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            found = list(maximal_repeats(left[a:b], right[a:b])) if b > a + 1 else []
            # A context by itself is a repeat where it has several places.
            found += [(len(left[a + k]), len(right[a + k]), [k]) for k in range(b - a) if len(left[a + k]) + len(right[a + k]) >= LENGTH]
            for x, y, members in found:
                bytes_ = left[a + members[0]][:x][::-1] + right[a + members[0]][:y]
                for k in members:
                    rows.append(a + k)
                    groups.append(hashlib.blake2b(bytes_, digest_size=16).hexdigest())
                    lengths.append(x + y)
                    before.append(x)
        if rows:
            keys = [pa.array(columns[c][rows]) for c in _KEY]
            extra = [pa.array(groups, pa.string()), pa.array(lengths, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys, *extra], [*_KEY, "group", "length", "x"])

    schema = "seed bigint, c1 bigint, c2 bigint, group string, length bigint, x bigint"
    found = scan_groups(own.placed, "seed", [], work, schema, GATHERED).distinct()
    at = own.at_places(found).select("group", "length", "digest", (F.col("place") - F.col("x")).alias("start")).distinct()
    at = stored(at.join(copies, "digest"), "groups")
    again = at.groupBy("group").agg(F.count("*").alias("n"), F.bool_or("copied").alias("any")).where("n > 1 or any").select("group")
    return at.join(again, "group", "left_semi").join(texts.select("digest", "doc_id"), "digest").select("group", "length", "doc_id", "start")


def repeat_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs(doc_id, text, …)``.

    A byte is removed when a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the
    same text or another one. Strings never cross texts and are judged on the texts as given.

    * Null and empty texts have no bytes. Texts shorter than ``LENGTH`` bytes lose nothing.
    * A text that another row repeats as a whole is removed as a whole from both; repeated rows give repeated result rows.
    * Rows without ``doc_id`` are judged like others. An empty table gives an empty result; other columns are ignored.
    """
    scanned, _, cuts = _settled(docs)
    gone = stored(cuts.select(F.col("digest").alias("_digest"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cuts")
    zero = F.lit(0).cast("long")
    joined = scanned.select("doc_id", "digest", "n_bytes", "sha256").join(gone, F.col("digest") == F.col("_digest"), "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, by the rule of :func:`repeat_report`.

    What a cut leaves of a character is dropped. Null texts stay null.
    """
    _, _, cuts = _settled(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode(errors="ignore") for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_digest", "_kept"])

    left = cuts.select("digest", "kept").mapInArrow(run, "_digest binary, _kept string")
    joined = docs.join(left, _digest(docs["text"]) == left["_digest"], "left")
    text = F.when(docs["text"].isNotNull(), F.coalesce(left["_kept"], docs["text"]))
    return joined.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
