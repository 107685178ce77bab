"""Alignment of two tokenizers over the same texts: byte offsets where tokens of both end, and which ids meet there.

Most groups between two such offsets are one token of each tokenizer with the same bytes. An array
that is made once from the vocabularies gives the second id for the first, so these groups are
counted in one vector a task, as long as the vocabulary. Only links of other groups are counted by a
shuffle of id pairs. The counts come back to the documents as vectors, as a list of the frequent pairs,
which cannot be many, and by a join for the rest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import slices

BYTE_BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Text that is worked on at a time in a task, in bytes.
BATCH_BYTES = 1_000_000
#: Pairs that hold at least one in so many of all links are sent to the tasks; there are no more than this.
FREQUENT = 400_000

MARK = "▁"


def _byte_of_character() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as characters: visible ones of Latin-1 as
    themselves, the others as the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Models:
    """Both tokenizers with the bytes of their tokens; ``same[a]`` is the id of B with the bytes of a, or -1."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte = _byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        b, plain = [], {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                plain.setdefault(b[-1], i)
        for i in range(len(b)):
            if self.b.is_byte(i):
                plain.setdefault(b[i], i)
        self.a_bytes, self.b_bytes = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in own], dtype=np.int64) for own in (a, b))
        self.same = np.array([plain.get(x, -1) for x in a], dtype=np.int64)
        # Every id with each mark that can follow it.
        self.names = pa.array([f"{i}{mark}" for i in range(max(len(a), len(b))) for mark in ",|;"], pa.large_binary())

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A for a blank and each text, and those of B, which adds the blank."""
        ours = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in ours], self.b.encode(texts, num_threads=2)


@lru_cache(maxsize=1)
def models(byte_bpe: str, pieces: bytes) -> Models:
    return Models(byte_bpe, pieces)


def read_models(byte_bpe: str = BYTE_BPE_PATH, pieces: str = PIECES_PATH) -> tuple[str, bytes]:
    with open(byte_bpe, encoding="utf-8") as f, open(pieces, "rb") as g:
        return f.read(), g.read()


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum())), sizes


def _spelled(vocabulary: pa.Array, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> list[memoryview]:
    """The bytes of the tokens of each text."""
    data = vocabulary.take(pa.array(ids))
    joined = memoryview(data.buffers()[2] or b"").cast("B")
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [joined[i:j] for i, j in zip(ends, ends[1:])]


class Groups:
    """The groups of the texts of a batch. ``a, b``: ids of all aligned texts in order; ``a_last, b_last``: where
    their groups end; ``n_a, n_b, n_groups``: counts by text, zero for texts without tokens."""

    def __init__(self, own: Models, texts: list[str]):
        a_ids, b_ids = own.tokens(texts)
        a, n_a = _flat(a_ids)
        b, n_b = _flat(b_ids)
        spelled = zip(_spelled(own.a_bytes, a, n_a, own.a_lengths), _spelled(own.b_bytes, b, n_b, own.b_lengths), texts)
        good = np.array([bool(t) and x == y and x == b" " + t.encode() for x, y, t in spelled], dtype=bool)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        # The texts have the same bytes in both, so places add up alike over all of them.
        a_ends, b_ends = np.cumsum(own.a_lengths[a]), np.cumsum(own.b_lengths[b])
        size = int(a_ends[-1]) + 1 if len(a_ends) else 1
        both = np.zeros(size, dtype=np.int8)
        both[a_ends] += 1
        both[b_ends] += 1
        self.a_last, self.b_last = both[a_ends] == 2, both[b_ends] == 2
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(self.a_last)])[np.concatenate([[0], np.cumsum(n_a)])])

    def links(self, own: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(a, b, regular)`` of the links, one a group: regular where the group is one token each and ``same`` tells b."""
        a, b = self.a[self.a_last], self.b[self.b_last]
        ones = (np.diff(np.flatnonzero(self.a_last), prepend=-1) == 1) & (np.diff(np.flatnonzero(self.b_last), prepend=-1) == 1)
        return a, b, ones & (own.same[a] == b)

    def strings(self, own: Models) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of A and B of its groups in order."""
        a_group, b_group = (np.cumsum(last) - last for last in (self.a_last, self.b_last))
        a_until, b_until = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (self.a_last, self.b_last))
        place = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        place[np.arange(len(self.a)) + b_until[a_group]] = 3 * self.a + self.a_last
        place[np.arange(len(self.b)) + a_until[b_group + 1]] = 3 * self.b + 2 * self.b_last
        data = own.names.take(pa.array(place))
        joined = memoryview(data.buffers()[2] or b"").cast("B")
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [joined[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]


def token_groups(docs: DataFrame, byte_bpe: str, pieces: bytes) -> DataFrame:
    """``(doc_id, groups)`` for every row of ``docs(doc_id, text, …)``: the groups written as ``a1,a2|b1;a3|b2,b3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models(byte_bpe, pieces)
        for batch in slices(batches, "text", BATCH_BYTES):
            groups = Groups(own, [t or "" for t in batch.column(1).to_pylist()])
            texts = [bytes(s).decode() for s in groups.strings(own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups string")


class Alignment:
    """What one pass over the texts has found: rows a document, the counts of ``a`` in regular links, and those of other pairs."""

    def __init__(self, docs: DataFrame, byte_bpe: str, pieces: bytes):
        own = models(byte_bpe, pieces)
        self.same, self.width = own.same, len(own.b_lengths)
        width, size = self.width, len(own.a_lengths)
        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = models(byte_bpe, pieces)
            row = TaskContext.get().partitionId() << 33
            vector = np.zeros(size, dtype=np.int64)
            schema: pa.Schema | None = None
            for batch in slices(batches, "text", BATCH_BYTES):
                groups = Groups(own, [t or "" for t in batch.column(1).to_pylist()])
                a, b, regular = groups.links(own)
                vector += np.bincount(a[regular], minlength=size)
                digests = [hashlib.sha256(s).hexdigest() if len(s) else "" for s in groups.strings(own)]
                until = np.concatenate([[0], np.cumsum(groups.n_groups)])
                inside = np.concatenate([[0], np.cumsum(regular)])[until]
                n = batch.num_rows
                found = {
                    "doc_id": batch.column(0),
                    "row": pa.array(row + np.arange(n)),
                    "n_a": pa.array(groups.n_a),
                    "n_b": pa.array(groups.n_b),
                    "n_groups": pa.array(groups.n_groups),
                    "groups_sha256": pa.array(digests, pa.string()),
                    "regular": pa.LargeListArray.from_arrays(inside, pa.array(a[regular], pa.int32())),
                    "other": pa.LargeListArray.from_arrays(until - inside, pa.array((a * width + b)[~regular], pa.int64())),
                }
                row += n
                # Where lists end in 32 bits, as the JVM reads them.
                for name in ("regular", "other"):
                    found[name] = found[name].cast(pa.list_(found[name].type.value_type))
                yield pa.RecordBatch.from_arrays([*found.values(), pa.nulls(n, pa.int64())], [*found, "n"])
                schema = pa.schema([*((k, v.type) for k, v in found.items()), ("n", pa.int64())])
            if schema is not None:
                ids = np.flatnonzero(vector)
                arrays = {"row": pa.array(ids), "n": pa.array(vector[ids])}
                yield pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else pa.nulls(len(ids), f.type) for f in schema], schema=schema)

        columns = "row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, regular array<int>, other array<bigint>, n bigint"
        found = stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}"), "aligned")
        self.rows = found.where("n IS NULL").drop("n")
        vectors = found.where("n IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
        self.vector = np.zeros(size, dtype=np.int64)
        self.vector[vectors.column("row").to_numpy()] = vectors.column("n").to_numpy()

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        counted = self.rows.select("other").mapInArrow(pairs, "pair bigint, n bigint")
        self.pairs = stored(counted.groupBy("pair").agg(F.sum("n").alias("n")), "id-pairs")

    def counts(self) -> DataFrame:
        """``(a, b, n)``: how many links hold each pair of ids."""
        session = self.rows.sparkSession
        ids = np.flatnonzero(self.vector)
        table = pa.table({"a": ids, "b": self.same[ids], "n": self.vector[ids]})
        return self.pairs.selectExpr(f"pair div {self.width} AS a", f"pair % {self.width} AS b", "n").union(session.createDataFrame(table))

    def report(self) -> DataFrame:
        """See :func:`alignment`."""
        spark = self.rows.sparkSession
        width, vector = self.width, self.vector
        # The highest count of each B id; no more rows than there are ids.
        irregular = self.pairs.groupBy(F.expr(f"pair % {width}").alias("b")).agg(F.max("n").alias("n"), F.sum("n").alias("links")).toArrow()
        best = np.zeros(width, dtype=np.int64)
        known = self.same >= 0
        np.maximum.at(best, self.same[known], vector[known])
        np.maximum.at(best, irregular.column("b").to_numpy(), irregular.column("n").to_numpy())
        # A pair with at least one in FREQUENT of all links is sent along; there cannot be more of them.
        least = max(1, -(-int(np.sum(irregular.column("links").to_numpy())) // FREQUENT))
        frequent = self.pairs.where(F.col("n") >= least).toArrow()
        order = np.argsort(frequent.column("pair").to_numpy())
        pair, count = (frequent.column(c).to_numpy()[order] for c in ("pair", "n"))
        same = np.maximum(self.same, 0)
        sent = spark.sparkContext.broadcast((vector, vector == best[same], pair, count, count == best[pair % width]))

        def known_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector, vector_best, pair, count, count_best = sent.value
            for batch in batches:
                a, others = (batch.column(i) for i in (1, 2))
                ids, codes = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, others))
                at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
                hit = pair[at] == codes if len(pair) else np.zeros(len(codes), dtype=bool)
                values = ((vector[ids], a), (vector_best[ids], a))
                extra = ((np.where(hit, count[at], 0) if len(pair) else codes * 0, others), (hit & count_best[at] if len(pair) else hit, others))
                sums = [np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[_ends(x)]) for v, x in (*values, *extra)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sums[0] + sums[2]), pa.array(sums[1] + sums[3])], ["row", "count_sum", "n_best"]
                )

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = sent.value[2]
            for batch in batches:
                codes = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                rows = np.repeat(batch.column(0).to_numpy(), np.diff(_ends(batch.column(1))))
                at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
                left = pair[at] != codes if len(pair) else np.ones(len(codes), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(rows[left]), pa.array(codes[left])], ["row", "pair"])

        sums = self.rows.select("row", "regular", "other").mapInArrow(known_sums, "row bigint, count_sum bigint, n_best bigint")
        if least > 1:  # otherwise all pairs were sent
            highest = pa.table({"b": np.arange(width), "best": best})
            rest = self.pairs.where(F.col("n") < least).withColumn("b", F.expr(f"pair % {width}"))
            rest = rest.join(F.broadcast(spark.createDataFrame(highest)), "b").select("pair", "n", (F.col("n") == F.col("best")).cast("bigint").alias("is_best"))
            lost = self.rows.select("row", "other").mapInArrow(rare, "row bigint, pair bigint").join(rest, "pair")
            added = lost.select("row", F.col("n").alias("count_sum"), F.col("is_best").alias("n_best"))
            sums = sums.union(added).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        plain = self.rows.select("doc_id", "row", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
        return plain.join(sums, "row").drop("row")


def _ends(lists: pa.Array) -> np.ndarray:
    """Where the lists of an array begin and end in its flattened values."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def alignment(docs: DataFrame, byte_bpe: str, pieces: bytes) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, count_sum, n_best)`` for every row of ``docs(doc_id, text, …)``.

    ``byte_bpe`` is the content of a byte-level tokenizer file, ``pieces`` that of a SentencePiece model.
    Strings of special tokens are plain text. Tokens have bytes, so every group ends in one link of its
    last ids. ``count_sum`` adds up the counts of the document's links over all documents, ``n_best`` tells
    how many of them have the highest count of their B id.

    * Null and empty texts, and those that either tokenizer does not spell out byte by byte, have
      no tokens: zeros and an empty digest.
    * Texts are aligned whole. Repeated rows give repeated rows and count as often; a null ``doc_id`` stays null; other
      columns are ignored whatever their names. An empty table gives an empty result.
    """
    return Alignment(docs, byte_bpe, pieces).report()
