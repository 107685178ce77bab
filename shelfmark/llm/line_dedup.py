"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are put in one order for the whole corpus, rare ones first.
Two sets whose Jaccard similarity reaches the threshold share a word among the first few of each
(the prefix filter), and the places of that word and the sizes of the sets bound how many words
they can share at all (the positional and length filters). Lines meet per prefix word; what passes
the filters is verified on the whole sets.

Only small rows travel: the first join carries sizes, places and a 64-bit parity sketch, and returns the sets
that have any likely partner; the second carries whole sets, but of these few only. Two sets have no word in
common before the first that they share, so there the words before it and the sketches of the words from it on
bound their difference. A prefix word that no other set has in its prefix brings no pair
together; a bit for each class of words tells which classes have two sets, and rows of the others are
not sent at all.

A word is known by 128 bits of a hash of its bytes, and a set by 128 bits made from those of its words. Rarity is
read off a table of counts over all lines, indexed by the word's hash and as large as the corpus asks
for; it orders words the same everywhere, which is all that correctness needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import digest_filter, in_filter, slices
from .groups import LEFT, RIGHT, WHOLE, index_pairs, large_keys, range_pairs, ranges, scan_groups, tiled

#: Similarity from which a later line is removed, as a fraction.
SIMILAR = (4, 5)
#: The table of counts has a class for each so many bytes of text, within these numbers of bits: it takes 128 MB at most.
BYTES_A_CLASS, COUNT_BITS = 256, (18, 27)
COUNT_CHUNK = 1 << 12
#: Bytes of a word's hash that sets are compared by.
WORD_BYTES = 6
#: Words up to this length are hashed together, longer ones each for itself.
SHORT_WORD = 512
#: Sets with more than one in so many of all lines are sent to all tasks; there are at most this many.
PARTS = 4096
#: One in so many sets is used to estimate which words are crowded.
SAMPLE = 32
BATCH_BYTES = 1_000_000
#: Bits below the side of a prefix row, above the number of words of its set and the place of its word.
SIDE_SHIFT, SIZE_SHIFT = 61, 30
#: Sets with all their words that are gathered at a time.
WORDY_ROWS = 20_000
#: Words of pairs that are verified at a time.
VERIFIED_WORDS = 4_000_000

#: A-Z in lower case, white space other than line breaks as blanks.
PLAIN = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\x0b\x0c\r", b"    ")), dtype=np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ np.uint64(salt)
    x *= _FACTOR
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


#: Bits of a token that are not its rarity.
_BARE = np.uint64((1 << 55) - 1)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: What the hashes of a word begin with, by its length.
_FIRST_SEEDS, _SECOND_SEEDS = (mixed(np.arange(SHORT_WORD + 1, dtype=np.uint64), salt) for salt in (3, 17))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two independent 64-bit hashes of each word, or the first one only, from eight bytes of all words at a time."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    seed = np.minimum(length, SHORT_WORD)
    # All words begin together; few have more than eight bytes, and long ones are hashed anew below.
    lane = eight[start] & _LOW_BYTES[np.minimum(length, 8)]
    first = mixed(_FIRST_SEEDS[seed] ^ lane, 5)
    second = mixed(_SECOND_SEEDS[seed] + lane * np.uint64(0xD6E8FEB86659FD93), 29) if both else None
    at, left = start + 8, np.where(length > SHORT_WORD, 0, length - 8)
    todo = np.flatnonzero(left > 0)
    while len(todo):
        lane = eight[at[todo]] & _LOW_BYTES[np.minimum(left[todo], 8)]
        first[todo] = mixed(first[todo] ^ lane, 5)
        if both:
            second[todo] = mixed(second[todo] + lane * np.uint64(0xD6E8FEB86659FD93), 29)
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    for i in np.flatnonzero(length > SHORT_WORD).tolist():
        digest = xxhash.xxh3_128_intdigest(data[start[i] : start[i] + length[i]].tobytes())
        first[i] = digest & (2**64 - 1)
        if both:
            second[i] = digest >> 64
    return first, second


class Lines:
    """The words and lines of a batch of texts.

    ``first_line[d]`` is the number of document ``d``'s first line within the batch; ``line``, ``word``
    and ``twin`` have the line and both hashes of each word.
    """

    def __init__(self, column: pa.Array, both: bool = True):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        data = PLAIN[data]
        breaks = np.flatnonzero(data == 10)
        # A line starts where a document does and behind each line break; an empty document has one empty line.
        per_doc = np.diff(np.searchsorted(breaks, ends)) + 1
        self.first_line = np.concatenate([[0], np.cumsum(per_doc)])
        line_starts = np.empty(self.first_line[-1], dtype=np.int64)
        is_first = np.zeros(len(line_starts), dtype=bool)
        is_first[self.first_line[:-1]] = True
        line_starts[is_first], line_starts[~is_first] = ends[:-1], breaks + 1
        space = (data == 32) | (data == 10)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[ends] = True
        inside = ~space
        begins = inside.copy()
        begins[1:] &= space[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= space[1:] | edge[1:-1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        words_before = np.searchsorted(start, line_starts)
        self.line = np.repeat(np.arange(len(line_starts)), np.diff(np.append(words_before, len(start))))
        self.word, self.twin = word_hashes(data, start, stop - start, both)
        self.lines = len(line_starts)

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(number, words, twins)``: the number of each word among the distinct ones, and the hashes of these."""
        number, words = pd.factorize(self.word)
        twins = np.zeros(len(words), dtype=np.uint64)
        twins[number] = self.twin
        if not np.array_equal(twins[number], self.twin):  # two words have one first hash
            both, number = np.unique(np.stack([self.word, self.twin], axis=1), axis=0, return_inverse=True)
            words, twins, number = both[:, 0], both[:, 1], number.ravel()
        return number, words, twins

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(line, token, twin)`` of the distinct words of each line, in any order; the tokens lack the rarity."""
        number, words, twins = self.numbered()
        bits = len(words).bit_length()
        key = np.sort(self.line << bits | number)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        line, number = key >> bits, key & ((1 << bits) - 1)
        return line, (words >> np.uint64(9))[number].view(np.int64), twins[number]

    def ordered(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(line, token, twin, place)`` of the distinct words of each line, rare ones first.

        A token is the rarity of a word above 55 bits of its hash; words with one token are told apart by their other hash.
        """
        number, words, twins = self.numbered()
        classes = (words & np.uint64(len(rarity) - 1)).astype(np.int64)
        tokens = rarity[classes].astype(np.uint64) << np.uint64(55) | words >> np.uint64(9)
        order = np.argsort(tokens)
        if np.any(tokens[order[1:]] == tokens[order[:-1]]):
            order = np.lexsort((twins, tokens))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        bits = len(order).bit_length()
        key = np.sort(self.line << bits | rank[number])
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        line, rank = key >> bits, key & ((1 << bits) - 1)
        at = np.arange(len(line))
        begins = np.ones(len(line), dtype=bool)
        begins[1:] = line[1:] != line[:-1]
        word = order[rank]
        token = (tokens[word] ^ np.uint64(1 << 63)).view(np.int64)
        return line, token, twins[word], at - np.maximum.accumulate(np.where(begins, at, 0))


def least_shared(n: np.ndarray, m: np.ndarray | int = 0) -> np.ndarray:
    """Words that sets of ``n`` and ``m`` words must share to be similar enough."""
    a, b = SIMILAR
    return -(-a * (n + m) // (a + b))


def prefix_length(n: np.ndarray) -> np.ndarray:
    a, b = SIMILAR
    return n - -(-a * n // b) + 1


def sketches(line: np.ndarray, token: np.ndarray, twin: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line the number of distinct words, both numbers that identify their set, and the parity of 64 classes of words."""
    size = np.bincount(line, minlength=lines)
    out = [np.zeros(lines, dtype=np.uint64) for _ in range(3)]
    full = np.flatnonzero(size)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        bare = token.view(np.uint64) & _BARE
        out[0][full] = np.add.reduceat(mixed(twin, 11), starts)
        out[1][full] = np.add.reduceat(mixed(mixed(twin, 13) ^ bare, 41), starts)
        out[2] = parities(bare, size)
    return size, *(x.view(np.int64) for x in out)


def parities(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parity of 64 classes of words, for each of the sets that the hashes of ``size`` words each make up."""
    out = np.zeros(len(size), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        out[full] = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(hashes, 7) >> np.uint64(58)), starts)
    return out


def suffix_parities(token: np.ndarray, begins: np.ndarray, parity: np.ndarray) -> np.ndarray:
    """For each prefix word the parity of its set without the words before it; ``begins`` is where the prefix begins."""
    bits = np.uint64(1) << (mixed(token.view(np.uint64) & _BARE, 7) >> np.uint64(58))
    before = np.bitwise_xor.accumulate(bits) ^ bits
    return parity.view(np.uint64) ^ before ^ before[begins]


def packed(twin: np.ndarray) -> np.ndarray:
    """The first bytes of hashes, as rows of bytes."""
    return twin.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def unpacked(data: bytes | memoryview) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WORD_BYTES)
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :WORD_BYTES] = rows
    return wide.view("<u8").ravel()


def token_class(token: np.ndarray, classes: int) -> np.ndarray:
    return (mixed(token.view(np.uint64), 23) & np.uint64(classes - 1)).astype(np.int64)


def _number(docs: DataFrame) -> Column:
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    return docs["doc_id"].cast("long") if whole else F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"]))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by the number of their id; ids that are no numbers are known by their hash."""
    return docs.select(_number(docs).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def class_bits(docs: DataFrame) -> int:
    """How many classes, as a power of two, the words of a corpus are counted in: by its size."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(max((size // BYTES_A_CLASS).bit_length(), COUNT_BITS[0]), COUNT_BITS[1])


def _chunks(classes: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted classes cut into chunks, each as its two-byte places followed by the bytes of their values."""
    chunk = classes // COUNT_CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(classes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            place = (classes[a:b] % COUNT_CHUNK).astype("<u2").tobytes()
            yield int(chunk[a]), place + b"".join(v[a:b].tobytes() for v in values)


def _summed(rows: DataFrame, size: int, kind: str, finish) -> np.ndarray:
    """One value for each of ``size`` classes: ``finish`` of the values of all tasks added up, chunk by chunk."""
    width = np.dtype(kind).itemsize

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNT_CHUNK, dtype=np.int64)
        for data in frame["data"]:
            n = len(data) // (2 + width)
            total[np.frombuffer(data, dtype="<u2", count=n)] += np.frombuffer(data, dtype=kind, offset=2 * n)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "data": [finish(total).tobytes()]})

    out = np.tile(finish(np.zeros(COUNT_CHUNK, dtype=np.int64)), size // COUNT_CHUNK)
    for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, data binary").toLocalIterator():  # ``size`` bytes in all
        out[r["chunk"] * COUNT_CHUNK : (r["chunk"] + 1) * COUNT_CHUNK] = np.frombuffer(r["data"], dtype=out.dtype)
    return out


def word_rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How frequent the words are that fall on each of ``size`` classes, as eight steps for each doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        for batch in slices(batches, "text", BATCH_BYTES):
            # A number of the table's own type: any other makes this forty times slower.
            np.add.at(total, (Lines(batch.column(0), both=False).word & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        found = np.flatnonzero(total)
        rows = list(_chunks(found, total[found].astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["chunk", "data"])

    steps = lambda n: np.minimum(255, np.floor(8 * np.log2(n + 1.0))).astype(np.uint8)
    return _summed(docs.select("text").mapInArrow(count, "chunk int, data binary"), size, "<u4", steps)


class _Pass:
    """Readings of all texts; the rarity of words is sent to the tasks once."""

    def __init__(self, docs: DataFrame):
        self.docs = _keyed(docs)
        self.classes = 1 << class_bits(docs)
        self.rarity = docs.sparkSession.sparkContext.broadcast(word_rarity(docs, self.classes))  # a byte for each class
        self.lines = stored(self._lines(), "lines")
        # A bit for each class.
        self.shared = docs.sparkSession.sparkContext.broadcast(np.packbits(self._shared_classes()))

    def _lines(self) -> DataFrame:
        """``(set, check, parity, size, doc_id, text_key, line, prefix)`` for every line that has words, lines numbered from 0.

        ``prefix`` has the first words of a set, and is null where the same batch has the set before.
        """
        rarity = self.rarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", BATCH_BYTES):
                own = Lines(batch.column(2))
                line, token, twin, place = own.ordered(rarity.value)
                size, identity, check, parity = sketches(line, token, twin, own.lines)
                full = np.flatnonzero(size)
                chosen = np.zeros(own.lines, dtype=bool)
                chosen[full[first_of(identity[full], check[full])]] = True
                first = chosen[full]
                kept = chosen[line] & (place < prefix_length(size)[line])
                ends = np.cumsum(np.where(first, prefix_length(size[full]), 0))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~first, [False]]))
                doc = np.searchsorted(own.first_line, full, side="right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x) for x in (identity[full], check[full], parity[full], size[full].astype(np.int32))),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array((full - own.first_line[doc]).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(token[kept])),
                    ],
                    ["set", "check", "parity", "size", "doc_id", "text_key", "line", "prefix"],
                )

        schema = "set bigint, check bigint, parity bigint, size int, doc_id bigint, text_key bigint, line int, prefix array<bigint>"
        return self.docs.mapInArrow(run, schema)

    def _shared_classes(self) -> np.ndarray:
        """For each class of prefix words whether more than one line of different batches, or two sets of one, have it."""
        size = self.classes

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype=np.uint8)
            for batch in batches:
                found, n = np.unique(token_class(batch.column(0).flatten().to_numpy(zero_copy_only=False), size), return_counts=True)
                total[found] = np.minimum(2, total[found] + np.minimum(2, n)).astype(np.uint8)
            found = np.flatnonzero(total)
            rows = list(_chunks(found, total[found]))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["chunk", "data"])

        rows = self.lines.where("prefix is not null").select("prefix").mapInArrow(count, "chunk int, data binary")
        return _summed(rows, size, "u1", lambda n: n > 1)

    def prefixes(self, share: int = 1, crowded: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
        """``(token, set, parity, place, prior)`` for the prefix words of each set that other sets may have, once a batch.

        ``place`` has the word's place below the number of words of the set, ``parity`` is that of the words from this one
        on, ``prior`` is the token before. Here a set goes by the first half of its identity alone: this only brings sets
        together. One in ``share`` of the sets is taken. Rows of ``crowded`` tokens, sorted and with their number of parts,
        go to every tile that their part meets: ``token`` then names the tile, and ``place`` has the side on top.
        """
        size, shared = self.classes, self.shared
        crowded = crowded and self.docs.sparkSession.sparkContext.broadcast(crowded)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prefix = batch.column(3)
                token = prefix.flatten().to_numpy(zero_copy_only=False)
                n = np.diff(prefix.offsets.to_numpy())
                begins = np.repeat(np.cumsum(n) - n, n)
                whose = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(token)) - begins
                prior = np.where(place > 0, np.concatenate([[0], token[:-1]]) if len(token) else token, 0)
                identity, parity, words = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                parity = suffix_parities(token, begins, parity[whose]).view(np.int64)
                of = token_class(token, size)
                keep = (shared.value[of >> 3] >> (7 - (of & 7)).astype(np.uint8)) & 1 == 1
                place = words.astype(np.int64)[whose] << SIZE_SHIFT | place
                columns = [x[keep] for x in (token, identity[whose], parity, place, prior)]
                if crowded:
                    columns = dealt_to_tiles(columns, *crowded.value)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "set", "parity", "place", "prior"])

        rows = self.lines.where("prefix is not null").select("set", "parity", "size", "prefix")
        if share > 1:
            rows = rows.where(F.pmod(F.xxhash64("set"), F.lit(share)) == 0)
        return rows.mapInArrow(run, "token bigint, set bigint, parity bigint, place bigint, prior bigint")

    def chosen(self, sets: DataFrame) -> DataFrame:
        """``(set, check, first, words)`` of the sets in ``sets(set)``: the first line that has each, and its words.

        A filter of fixed size spares most other lines, an exact join the rest of them.
        """
        sets = stored(sets, "wanted-sets")
        bits = sets.sparkSession.sparkContext.broadcast(digest_filter(sets, "set", "set"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", BATCH_BYTES):
                own = Lines(batch.column(2))
                line, token, twin = own.distinct()
                size, identity, check, _ = sketches(line, token, twin, own.lines)
                wanted = (size > 0) & in_filter(bits.value, identity, identity)
                full = np.flatnonzero(wanted)
                doc = np.searchsorted(own.first_line, full, side="right") - 1
                at = pa.array(doc)
                # The words of a set go along once a batch.
                with_words = np.zeros(own.lines, dtype=bool)
                with_words[full[first_of(identity[full], check[full])]] = True
                data = packed(twin[with_words[line]]).tobytes()
                ends = np.cumsum(np.where(with_words[full], size[full] * WORD_BYTES, 0)).tolist()
                words = [data[a:b] if b > a else None for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(identity[full]), pa.array(check[full]), batch.column(0).take(at), batch.column(1).take(at),
                        pa.array((full - own.first_line[doc]).astype(np.int32)), pa.array(words, pa.binary()),
                    ],
                    ["set", "check", "doc_id", "text_key", "line", "words"],
                )

        rows = self.docs.mapInArrow(run, "set bigint, check bigint, doc_id bigint, text_key bigint, line int, words binary")
        found = rows.join(sets, "set", "left_semi").groupBy("set", "check")
        return found.agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"), F.first("words", ignorenulls=True).alias("words"))


def first_of(identity: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where each pair of numbers occurs first."""
    order = np.lexsort((check, identity))
    a, b = identity[order], check[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def dealt_to_tiles(columns: list[np.ndarray], crowded: np.ndarray, parts: np.ndarray) -> list[np.ndarray]:
    """Prefix rows with those of crowded tokens once for every tile that their part meets, as :func:`groups.tiled` does."""
    token, identity = columns[:2]
    at = np.minimum(np.searchsorted(crowded, token), len(crowded) - 1)
    found = crowded[at] == token
    rows = np.flatnonzero(found)
    if not len(rows):
        return columns
    n = parts[at[rows]].astype(np.int64)
    own = (mixed(identity[rows].view(np.uint64), 37) % n.astype(np.uint64)).astype(np.int64)
    other = ranges(np.zeros(len(n), dtype=np.int64), n)
    rows, own, n = np.repeat(rows, n), np.repeat(own, n), np.repeat(n, n)
    tile = (np.minimum(own, other) * n + np.maximum(own, other)).astype(np.uint64)
    side = np.where(own == other, WHOLE, np.where(own < other, LEFT, RIGHT)).astype(np.int64)
    meet = mixed(mixed(token[rows].view(np.uint64), 43) + tile).view(np.int64)
    out = [np.concatenate([x[~found], x[rows]]) for x in columns]
    out[0][-len(rows) :] = meet
    out[3][-len(rows) :] |= side << SIDE_SHIFT
    return out


def size_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, size: np.ndarray, place: np.ndarray):
    """``(order, pairs)``: the rows of groups by side and size, and blocks of pairs of their places in that order.

    Sets that first share the words at these places have at most the words from there on in common, so a partner's size is bounded.
    """
    a, b = SIMILAR
    most = (a + b) * (size - place) // a - size
    unit = max(int(size.max()), int(most.max())) + 2
    kind = np.repeat(np.arange(len(starts)), ends - starts) * 3
    key = (kind + side) * unit + size
    order = np.argsort(key)
    key, side, size, most, kind = key[order], side[order], size[order], most[order], kind[order]
    left = side == LEFT
    meets = (kind + np.where(left, RIGHT, side)) * unit
    low = np.where(left, np.searchsorted(key, meets + -(-a * size // b)), np.arange(len(key)) + 1)
    high = np.where(side == RIGHT, 0, np.searchsorted(key, meets + np.maximum(most, 0), side="right"))
    return order, range_pairs(np.arange(len(key)), low, high)


def likely_sets(read: _Pass) -> DataFrame:
    """``(set, token)`` of all sets that have another within the filters at some prefix word, with these words or their tiles.

    Two sets with the same word before this one have met there, and are not compared again.
    """
    a, b = SIMILAR

    def work(columns, starts, ends) -> Iterator[pa.RecordBatch]:
        columns["side"] = columns["place"] >> SIDE_SHIFT
        columns, starts, ends = once(columns, starts, ends)
        size = (columns["place"] >> SIZE_SHIFT) & ((1 << SIDE_SHIFT - SIZE_SHIFT) - 1)
        place = columns["place"] & ((1 << SIZE_SHIFT) - 1)
        order, pairs = size_pairs(starts, ends, columns["side"], size, place)
        identity, prior, token = (columns[c][order] for c in ("set", "prior", "token"))
        parity, size, place = columns["parity"].view(np.uint64)[order], size[order], place[order]
        left = (b - a) * size - (a + b) * place
        likely = np.zeros(len(identity), dtype=bool)
        for i, j in pairs:
            # What the sketches leave is little, so that the other filters see few pairs.
            differing = np.bitwise_count(parity[i] ^ parity[j]).astype(np.int64)
            near = np.flatnonzero((a + b) * differing <= left[i] + left[j])
            i, j, differing = i[near], j[near], differing[near]
            n, m = size[i], size[j]
            shared = least_shared(n, m)
            near = (identity[i] != identity[j]) & (b * np.minimum(n, m) >= a * np.maximum(n, m))
            near &= np.minimum(n - place[i], m - place[j]) >= shared
            near &= differing + place[i] + place[j] <= n + m - 2 * shared
            near &= (prior[i] != prior[j]) | (place[i] == 0) | (place[j] == 0)
            likely[i[near]] = True
            likely[j[near]] = True
        if likely.any():
            yield pa.RecordBatch.from_arrays([pa.array(identity[likely]), pa.array(token[likely])], ["set", "token"])

    crowded = large_keys(read.prefixes(SAMPLE), "token", SAMPLE)
    if crowded is not None:  # a key for so many thousand prefix rows
        keys = crowded.toPandas().sort_values("token")
        crowded = keys["token"].to_numpy(np.int64), keys["parts"].to_numpy(np.int64)
    return scan_groups(read.prefixes(crowded=crowded), "token", [], work, "set bigint, token bigint").distinct()


def once(columns: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The rows of groups, each set once a side, so that copies of a set are no pairs."""
    identity, side = columns["set"], columns["side"]
    group = np.repeat(np.arange(len(starts)), ends - starts)
    number, distinct = pd.factorize(mixed(identity.view(np.uint64) ^ mixed((group << 2 | side).astype(np.uint64), 19), 31))
    if len(distinct) == len(identity):
        return columns, starts, ends
    first = np.empty(len(distinct), dtype=np.int64)
    first[number[::-1]] = np.arange(len(identity))[::-1]
    first = first[number]
    kept = first == np.arange(len(identity))
    kept |= (identity != identity[first]) | (group != group[first]) | (side != side[first])
    before = np.concatenate([[0], np.cumsum(kept)])
    return {name: column[kept] for name, column in columns.items()}, before[starts], before[ends]


def shared_words(i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words the sets ``i`` and ``j`` share; set ``k`` has the word numbers ``words[low[k]:high[k]]``."""
    own = np.concatenate([i, j])
    pair = np.tile(np.arange(len(i)), 2)
    n = high[own] - low[own]
    unit = int(words.max()) + 1 if len(words) else 1
    key = np.sort(np.repeat(pair, n) * unit + words[ranges(low[own], high[own])])
    return np.bincount(key[1:][key[1:] == key[:-1]] // unit, minlength=len(i))


def later_sets(lines: DataFrame, likely: DataFrame) -> DataFrame:
    """``(set, check)`` of the rows of ``lines(set, check, first, words)`` that are similar enough to an earlier row.

    Rows meet at the words of ``likely(set, token)`` only, as every similar pair is likely at the first prefix word it shares.
    """
    # Rows without id come first.
    doc = F.coalesce("first.doc_id", F.lit(-(2**63)))
    flat = lines.select("set", "check", "words", doc.alias("doc_id"), "first.text_key", "first.line")

    def work(columns, starts, ends) -> Iterator[pa.RecordBatch]:
        identity, check = columns["set"], columns["check"]
        doc, key, line = columns["doc_id"], columns["text_key"], columns["line"]
        words = columns["words"]
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        hashes = unpacked(memoryview(words.buffers()[2])[offsets[0] : offsets[-1]])
        offsets = (offsets - offsets[0]) // WORD_BYTES
        numbers = pd.factorize(hashes)[0]
        size = np.diff(offsets)
        parity = parities(hashes, size)
        gone = np.zeros(len(identity), dtype=bool)
        for i, j in index_pairs(starts, ends, columns["side"]):
            near = ((identity[i] != identity[j]) | (check[i] != check[j])) & (SIMILAR[1] * np.minimum(size[i], size[j]) >= SIMILAR[0] * np.maximum(size[i], size[j]))
            i, j = i[near], j[near]
            # Sets whose parities differ in more bits than similar sets have different words need not be counted.
            near = np.bitwise_count(parity[i] ^ parity[j]) <= size[i] + size[j] - 2 * least_shared(size[i], size[j])
            i, j = i[near], j[near]
            earlier = (doc[i] < doc[j]) | (doc[i] == doc[j]) & ((key[i] < key[j]) | (key[i] == key[j]) & (line[i] < line[j]))
            late = np.where(earlier, j, i)
            part = np.cumsum(size[i] + size[j]) // VERIFIED_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(i)]
            for a, b in zip(cuts, cuts[1:]):
                open_ = np.flatnonzero(~gone[late[a:b]]) + a
                if len(open_):
                    x, y = i[open_], j[open_]
                    shared = shared_words(x, y, offsets[:-1], offsets[1:], numbers)
                    gone[late[open_[shared >= least_shared(size[x], size[y])]]] = True
        found = np.flatnonzero(gone)
        found = found[first_of(identity[found], check[found])]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(identity[found]), pa.array(check[found])], ["set", "check"])

    rows = flat.join(likely, "set").select("token", "set", "check", "words", "doc_id", "text_key", "line")
    crowded = large_keys(likely.where(F.pmod(F.xxhash64("set"), F.lit(SAMPLE)) == 0), "token", SAMPLE)
    placed = tiled(rows, crowded, "token", "set")
    return scan_groups(placed, "token", [], work, "set bigint, check bigint", WORDY_ROWS).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, lines)``: the numbers of the removed lines of each row that has any, sorted."""
    read = _Pass(docs)
    likely = stored(likely_sets(read), "likely-sets")
    chosen = stored(read.chosen(likely.select("set").distinct()), "likely-lines")
    gone = stored(later_sets(chosen, likely), "later-sets").withColumn("gone", F.lit(True))
    lines = read.lines.select("set", "check", "doc_id", "text_key", "line")
    here = F.struct("doc_id", "text_key", "line")
    counted = lines.groupBy("set", "check").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    # Of sets that occur once and are not removed nothing goes, so they need not meet their lines again.
    marked = stored(counted.join(gone, ["set", "check"], "left").where("n > 1 or gone"), "marked-sets")
    # Very common lines are met where they are: there are at most PARTS of them.
    most = max(1, lines.count() // PARTS)
    common, others = F.broadcast(marked.where(F.col("n") > most)), marked.where(F.col("n") <= most)
    joined = lines.join(common, ["set", "check"]).union(lines.join(others, ["set", "check"]))
    gone_here = joined.where(F.col("gone").isNotNull() | ~here.eqNullSafe(F.col("first")))
    return gone_here.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` for every row of ``docs(doc_id, text, …)``.

    ``doc_id`` is a whole number; other kinds of ids are ordered by their hash. Lines end at line breaks; their words are runs without white space,
    A-Z lower-cased, each counted once. A line goes when an earlier line has the same words, or words
    with a Jaccard similarity of at least 0.8; earlier means a smaller ``doc_id``, then a smaller hash of the text, then a
    smaller line number, and the earlier line may itself go. ``removed`` has the line numbers from 0, comma-joined.

    * Null and empty texts have one empty line; lines without words never go.
    * Rows that agree in ``doc_id`` and text count once and get the same result; rows without ``doc_id`` come first.
    * Very long lines are compared whole. An empty table gives an empty result; other columns are
      ignored whatever their names.
    """
    text = F.coalesce("text", F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            breaks = pc.count_substring(batch.column(3), "\n").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pc.add(breaks, 1)], ["doc_id", "_number", "text_key", "n_lines"])

    rows = docs.select("doc_id", _number(docs).alias("_number"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    own = rows.mapInArrow(count, T.StructType([*rows.schema.fields[:3], T.StructField("n_lines", T.LongType())]))
    gone = removed_lines(docs).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "lines")
    joined = own.join(gone, F.col("_number").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    removed = F.coalesce("lines", F.expr("cast(array() as array<int>)"))
    return joined.select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed")
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, by the rule of :func:`line_report`.

    All rows stay; a text whose lines all go becomes empty, a null text stays null.
    """
    gone = removed_lines(docs).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("lines").alias("_lines"))
    same = _number(docs).eqNullSafe(gone["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_key"])
    # The names of the columns are those of ``docs`` whatever they are, and one that only the next step reads.
    joined = docs.join(gone, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], gone["_lines"].alias("_removed_lines"))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone_here in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if gone_here:
                    skip = set(gone_here)
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in skip])
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
