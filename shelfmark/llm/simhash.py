"""SimHash near-duplicates, found by anchors from a covering code.

Fingerprints have 64 bits. Six pieces of ten bits each are joined to six triples of pieces, chosen
so that however four differing bits fall on the pieces, some triple holds at most one of them
(``TRIPLES``, checked by a test). Within a triple the anchors are the words of the binary Hamming
code of length 31, a perfect code: every string lies within one bit (the covering radius) of
exactly one anchor. A fingerprint is replicated to every anchor within covering radius plus
threshold, here 1 + 1 bits: its own and 15 more. Of two fingerprints that differ in at most one
bit of the triple, each reaches the other's own anchor, so all links are found by comparing, per
anchor, those that own it with all that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .groups import forest, index_pairs, large_keys, scan_groups, tiled

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

PIECE_BITS = 10
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 4, 5), (2, 3, 4), (2, 3, 5), (1, 4, 5)]
#: Bits of a triple that may differ for a link to be found in it.
TRIPLE_BITS = 1

#: One in so many fingerprints is used to estimate which anchors are crowded.
SAMPLE = 64

_BLOCK = 65_536


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as an unsigned integer. A-Z are lower-cased, words end at ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(ones * 2 > n, bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row of ``docs(doc_id, text, …)``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [fingerprint(t.as_py() or b"", words) for t in texts]
            prints = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the five parity checks, and per syndrome the 15 pairs of bits that lead to code words two bits away."""
    checks = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)], dtype=np.int64)
    pairs = np.zeros((32, 15), dtype=np.int64)
    for s in range(1, 32):
        pairs[s] = [(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p != s and p < p ^ s]
    return checks, pairs


CHECKS, PAIRS = _code_tables()


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, index of the fingerprint, owned)`` for every anchor in reach of each fingerprint.

    The key holds the triple's number above the anchor's 31 bits.
    """
    prints = prints.astype(np.int64).view(np.uint64)
    keys, index, owned = [], [], []
    here = np.arange(len(prints))
    for number, triple in enumerate(TRIPLES):
        word = np.zeros(len(prints), dtype=np.int64)
        for place, piece in enumerate(triple):
            bits = (prints >> np.uint64(PIECE_BITS * piece)) & np.uint64((1 << PIECE_BITS) - 1)
            word |= bits.astype(np.int64) << (PIECE_BITS * place)
        syndrome = np.zeros(len(prints), dtype=np.int64)
        for b, mask in enumerate(CHECKS):
            syndrome |= (np.bitwise_count(word & mask).astype(np.int64) & 1) << b
        own = np.where(syndrome > 0, word ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), word)
        off = np.flatnonzero(syndrome)  # a code word has no other code word within two bits
        near = word[off, None] ^ PAIRS[syndrome[off]]
        top = np.int64(number) << 31
        keys += [own | top, near.ravel() | top]
        index += [here, np.repeat(here[off], 15)]
        owned += [np.ones(len(own), dtype=bool), np.zeros(near.size, dtype=bool)]
    return np.concatenate(keys), np.concatenate(index), np.concatenate(owned)


def _anchored(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                block = values[at : at + 4096]
                key, index, owned = anchors(block)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block[index]), pa.array(owned)], ["anchor", "print", "owned"])

    return prints.mapInArrow(run, "anchor bigint, print bigint, owned boolean")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``print`` values of ``prints`` that connect the same
    values as all pairs within ``max_bits`` bits do, a few per value instead of all pairs.

    ``max_bits`` is at most ``MAX_BITS``, for which the triples are made.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be between 0 and {MAX_BITS}")

    def work(columns, starts, ends) -> Iterator[pa.RecordBatch]:
        value, owned = columns["print"].view(np.uint64), columns["owned"]
        found_a, found_b = [], []
        for first, second in index_pairs(starts, ends, columns["side"]):
            close = (owned[first] | owned[second]) & (np.bitwise_count(value[first] ^ value[second]) <= max_bits)
            if close.any():
                a, b = forest(value[first[close]].view(np.int64), value[second[close]].view(np.int64))
                found_a.append(a)
                found_b.append(b)
        if found_a:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    crowded = large_keys(_anchored(prints.where(F.pmod(F.xxhash64("print"), F.lit(SAMPLE)) == 0)), "anchor", SAMPLE)
    return scan_groups(tiled(_anchored(prints), crowded, "anchor", "print"), "anchor", [], work, "a bigint, b bigint")


def hexadecimal(print_column: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_column), 16, "0"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, …)``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id``
    is the smallest ``doc_id`` that can be reached over links, itself included.

    * A null or empty text, or one of white space only, has fingerprint zero and is linked like any other.
    * Equal fingerprints are compared once, however many documents have them.
    * Repeated rows give repeated result rows. A row without ``doc_id`` takes part but names no
      component; a component of such rows only has a null id.
    * Other columns are ignored whatever their names. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    values = stored(prints.groupBy(F.col("fingerprint").alias("print")).agg(F.min("doc_id").alias("first")), "prints")
    linked = components(links(values.select("print"), max_bits), "a", "b")
    classes = values.join(linked, values["print"] == linked["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select(F.col("print").alias("fingerprint"), "component_id")
    return prints.join(named, "fingerprint").select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest ``doc_id``.

    Of repeated rows with that id one stays. Rows without ``doc_id`` cannot be told apart and all stay.
    """
    found = near_duplicates(docs, words, max_bits)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select([f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
