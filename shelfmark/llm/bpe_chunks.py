"""Byte-pair encoding of documents that share passages: every shared chunk is encoded once.

Texts are cut where a rolling hash of the last bytes says so, which cuts equal passages alike wherever
they stand. The digests of all chunks are counted; those that occur again are encoded once for the
whole table and their ids are handed to the documents by a join. Everything else, with the joins of the
chunks, is encoded in its document: a chunk is only shared between its first and its last blank behind a
word, and the text around a join is encoded from one whole word inside the chunk on its left to one
inside the chunk on its right. The ids of these two words have to agree exactly with those inside the
chunks; a document where they do not is encoded again as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import digest_filter, in_filter, slices, utf8
from .groups import ranges

MODEL_PATH = "/opt/tokenizers/word_bpe_49k.json"
#: Text that is worked on at a time in a task, in bytes.
BATCH_BYTES = 1_000_000
#: A chunk ends where this many leading bits of the rolling hash are zero: about every 512 bytes,
CUT_BITS = 9
#: but not within this many bytes of another place like that.
LEAST_BYTES = 64
#: Chunks with more than one in so many of all occurrences are handed out in several parts.
PARTS = 4096
#: Digests of chunks a task remembers to have sent.
REMEMBERED = 1_000_000
#: What stands between blanks is known from batch to batch until there are so many of them, or so many bytes.
UNITS, UNIT_BYTES = 300_000, 8_000_000
#: Units that are put into one text for the library.
GLUED = 128
#: Bytes of characters that no step of a tokenizer makes longer or shorter: visible ASCII without the sign that special tokens
#: begin with, blanks, and the letters of Latin-1. Their lead byte is the only one here, so no other bytes can follow it.
_KEPT = bytes([9, 10, 32, *(b for b in range(33, 127) if b != ord("<")), 0xC3, *range(0x80, 0xC0)])

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], dtype=np.uint32)


def read_model(path: str = MODEL_PATH) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Codec:
    """Encodes and decodes lists of texts with one tokenizer."""

    def __init__(self, model: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(model)
        self.own.no_truncation()
        self.own.no_padding()
        self.by_unit = cuttable(model)
        self._forget()
        # Without a decoder the library puts blanks between the tokens.
        names = {i: t for t, i in self.own.get_vocab(with_added_tokens=True).items()}
        names = [names.get(i, "") for i in range(max(names) + 1)]
        self.tokens = None
        if self.own.decoder is None:
            printed = [f"{t} ".encode() for t in names]
            self.tokens = pa.array(printed, pa.large_binary())
            self.sizes = np.array([len(t) for t in printed], dtype=np.int64)
        # A byte is a character of a token where the tokenizer works on bytes.
        on_bytes = '"ByteLevel"' in json.dumps(json.loads(model).get("pre_tokenizer"))
        suffix = json.loads(model)["model"].get("end_of_word_suffix") or ""
        self.spelled = np.array([len(t.removesuffix(suffix)) for t in names], dtype=np.int64) if on_bytes else None

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all texts, one after the other, and where each text's ids end.

        By the library, special tokens only where their strings are in the text. Where the tokenizer can be cut at
        blanks, what stands between two of them is encoded once for all its places in some batches of texts.
        """
        if not self.by_unit:
            ids = [e.ids for e in self.own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return flat(ids)
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        array = np.frombuffer(data, dtype=np.uint8)
        blanks = blanks_behind_words(array) if len(array) > 1 else np.zeros(0, dtype=np.int64)
        is_edge = np.zeros(len(data) + 1, dtype=bool)
        is_edge[0] = is_edge[blanks] = is_edge[ends] = True
        edges = np.flatnonzero(is_edge)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(units.dictionary.to_pylist())[units.indices.to_numpy(zero_copy_only=False)]
        low, high = self._ends[number], self._ends[number + 1]
        total = np.concatenate([[0], np.cumsum(high - low)])
        return self._ids[ranges(low, high)], total[np.searchsorted(edges, ends)]

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit among the known ones; new ones are encoded and, in a bounded number, kept for the next batches."""
        if len(self._known) > UNITS or self._bytes > UNIT_BYTES:
            self._forget()
        new = [u for u in units if u not in self._known]
        if new:
            ids, ends = self._encode_units(new)
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new))))
            self._bytes += sum(map(len, new))
            self._ends = np.concatenate([self._ends, self._ends[-1] + ends])
            self._ids = np.concatenate([self._ids, ids])
        return np.array([self._known[u] for u in units], dtype=np.int64)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units by the library. Many that surely keep their bytes are one text for it, cut like any other at
        the blanks they begin with; the bytes of the tokens tell where each ends, or else the text is taken apart again."""
        plain = []
        if self.spelled is not None:
            plain = [i for i, u in enumerate(units) if u[0] in b" \t\n" and u[-1] > 32 and not u.translate(None, _KEPT)]
        found: list = [None] * len(units)
        groups = [plain[at : at + GLUED] for at in range(0, len(plain), GLUED)]
        texts = [b"".join([units[i] for i in group]).decode() for group in groups]
        for group, text, encoding in zip(groups, texts, self.own.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype=np.uint32)
            total = np.concatenate([[0], np.cumsum(self.spelled[ids])])
            sizes = [len(units[i].translate(None, b" \t\n")) for i in group]
            if total[-1] != sum(sizes):  # blanks may be parts of tokens
                sizes = [len(units[i]) for i in group]
            places = np.cumsum(sizes)
            cuts = np.searchsorted(total, places)
            if cuts[-1] < len(total) and np.array_equal(total[cuts], places):
                for i, a, b in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist()):
                    found[i] = ids[a:b]
        rest = [i for i, f in enumerate(found) if f is None]
        for i, encoding in zip(rest, self.own.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False)):
            found[i] = encoding.ids
        return flat(found)

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._bytes = 0
        self._ids = np.zeros(0, dtype=np.uint32)
        self._ends = np.zeros(1, dtype=np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts that ids decode to, special tokens included."""
        bounds = np.concatenate([[0], ends])
        if self.tokens is None:
            return self.own.decode_batch([ids[a:b].tolist() for a, b in zip(bounds, ends)], skip_special_tokens=False)
        joined = memoryview(self.tokens.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        places = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds].tolist()
        return [str(joined[a : max(a, b - 1)], "utf-8") for a, b in zip(places, places[1:])]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and where each list ends."""
    ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
    return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(ends[-1]) if len(ends) else 0), ends


def parts_of(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end inside texts ``data[start:end]`` that follow each other in ``data``: sorted places between two characters."""
    rolled = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        wider = rolled.copy()
        wider[k:] += rolled[:-k] << np.uint32(k)
        rolled = wider
    places = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1
    text = np.searchsorted(starts, places, side="right") - 1
    inside = (text >= 0) & (places < ends[text])
    places, text = places[inside], text[inside]
    inside = (places - starts[text] >= LEAST_BYTES) & (data[places] & 0xC0 != 0x80)
    places, text = places[inside], text[inside]
    before = np.concatenate([[-LEAST_BYTES], places[:-1]])
    return places[places - before >= LEAST_BYTES]


def blanks_behind_words(data: np.ndarray) -> np.ndarray:
    """Places of a blank, tab or newline right behind a visible ASCII character or one of two bytes that is no white
    space, where texts can be cut without changing ids."""
    blank = (data == 32) | (data == 9) | (data == 10)
    places = np.flatnonzero(blank[1:]) + 1
    before, lead = data[places - 1], data[np.maximum(places - 2, 0)]
    return places[(before > 32) & (before < 127) | (before > 127) & (lead >= 0xC3) & (lead <= 0xDF)]


class Layout:
    """The chunks of the texts of a batch: ``first, second, second_last, last`` are the places of the
    blanks behind words that a chunk is shared between, and the next ones inside of them."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        array = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        full = sizes > 0
        cuts = cut_points(array, self.starts[full], self.ends[full]) if len(array) else np.zeros(0, dtype=np.int64)
        edges = np.unique(np.concatenate([self.starts[full], self.ends[full], cuts]))
        low, high = edges[:-1], edges[1:]
        blanks = blanks_behind_words(array) if len(array) else np.zeros(0, dtype=np.int64)
        a, b = np.searchsorted(blanks, low, side="right"), np.searchsorted(blanks, high, side="left")
        shared = b - a >= 4
        a, b = a[shared], b[shared]
        self.first, self.second, self.second_last, self.last = blanks[a], blanks[a + 1], blanks[b - 2], blanks[b - 1]
        self.text = np.searchsorted(self.ends, self.first, side="right")
        pieces = [self.data[i:j] for i, j in zip(self.first.tolist(), self.last.tolist())]
        self.digests = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in pieces]), dtype=np.int64).reshape(-1, 2)


def shared_chunks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``(h1, h2, n)`` of the chunks that occur more than once in ``docs(text)``, and the number of all occurrences."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found, n = np.unique(Layout(utf8(batch.column(0))).digests, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])

    counted = docs.select("text").mapInArrow(digests, "h1 bigint, h2 bigint, n bigint").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    known = stored(counted.where("n > 1"), "chunk-counts")
    return known, known.agg(F.sum("n")).first()[0] or 0


Output = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def ids_and_texts(model: str) -> tuple[Output, str]:
    """Output columns of :func:`encode`: the ids, their number, and the text that they decode to."""

    def columns(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        texts = codec(model).decode(ids, ends)
        bounds = np.concatenate([[0], ends])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
        return [lists, pa.array(np.diff(bounds), pa.int64()), pa.array(texts, pa.string())]

    return columns, "ids array<int>, n_tokens bigint, decoded string"


def digests(model: str) -> tuple[Output, str]:
    """Output columns of :func:`encode`: the number of ids, the SHA-256 of the ids as little-endian
    unsigned 32-bit integers, and that of the text they decode to."""

    def columns(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        texts = codec(model).decode(ids, ends)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        packed = ids.astype("<u4", copy=False)
        return [
            pa.array(np.diff(ends, prepend=0), pa.int64()),
            pa.array([sha(i.tobytes()) for i in parts_of(packed, ends)], pa.string()),
            pa.array([sha(t.encode()) for t in texts], pa.string()),
        ]

    return columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` for every row of ``tokens(doc_id, ids, …)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec(model).decode(*flat([i or [] for i in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def cuttable(model: str) -> bool:
    """True when a blank behind a visible ASCII character always begins a word of its own: the tokenizer splits
    texts at blanks, no added token has blanks in or around it, and nothing is added to the beginning of a text."""
    own = json.loads(model)
    steps = own.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    splits = [s for s in steps if s.get("type") in ("Split", "ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer")]
    by_rule = bool(splits) and splits[0]["type"] != "Split" and (splits[0]["type"] != "ByteLevel" or splits[0].get("use_regex", True))
    by_pattern = bool(splits) and splits[0]["type"] == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
    if by_pattern:  # kept are the matches; none of them may hold a blank in it or behind its first character
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(splits[0]["pattern"].get("Regex", "")), "removed", invert=True)
        by_pattern = all(" " not in word for word, _ in split.pre_tokenize_str("a b. c' d1 2 ,e 's é ü-  x"))
    normal = own.get("normalizer") or {}
    normal = [n for n in normal.get("normalizers", [normal]) if n]
    letters = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in normal)
    plain = not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in own.get("added_tokens", []))
    return (by_rule or by_pattern) and letters and plain and not any(s.get("add_prefix_space") for s in steps)


def encode(docs: DataFrame, model: str, output: tuple[Output, str] | None = None) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded)``, or other columns of ``output``, for every row of ``docs(doc_id, text, …)``.

    ``model`` is the content of a tokenizer file. The ids are those of the whole text, ``decoded`` is what
    they decode to, special tokens included.

    * Null and empty texts have no ids and an empty text.
    * A text of any length is encoded whole. Without blanks it has no chunks to share.
    * Repeated rows give repeated rows; a null ``doc_id`` stays null; other columns are ignored
      whatever their names. An empty table gives an empty result.
    * Texts are never cut for tokenizers that do not split them at blanks (:func:`cuttable`).
    """
    columns, schema = output or ids_and_texts(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    names = ["doc_id", *(f.split(" ")[0] for f in schema.split(", "))]

    def result(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
        extra = extra or {}
        return pa.RecordBatch.from_arrays([doc_ids, *columns(ids, ends), *extra.values()], [*names, *extra])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            yield result(batch.column(0), *codec(model).encode(utf8(batch.column(1))))

    if not cuttable(model):
        return docs.mapInArrow(whole, f"doc_id {kind}, {schema}")
    shared, occurrences = shared_chunks(docs)
    bits = docs.sparkSession.sparkContext.broadcast(digest_filter(shared, "h1", "h2"))
    # Where the filter is too full, chunks that occur once are taken for shared ones: more is moved, the results are the same.
    # One pass over the texts: results of documents without shared chunks, and of the others what is encoded
    # in them ("gaps"), which chunks they hold ("ref") and the texts of these ("chunk").
    moved = "kind string, row bigint, place int, h1 bigint, h2 bigint, body string, gaps binary, lengths array<int>"
    moved_arrow = pa.schema(
        [("kind", pa.string()), ("row", pa.int64()), ("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("body", pa.string())]
        + [("gaps", pa.binary()), ("lengths", pa.list_(pa.int32()))]
    )

    def filled(arrays: dict[str, pa.Array], rows: int, own: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else pa.nulls(rows, f.type) for f in own], schema=own)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        sent: set[tuple[int, int]] = set()
        own: pa.Schema | None = None
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = utf8(batch.column(1))
            layout = Layout(texts)
            hit = np.flatnonzero(in_filter(bits.value, *np.ascontiguousarray(layout.digests.T)))
            held = np.unique(layout.text[hit])
            plain = np.setdiff1d(np.arange(len(texts)), held)
            done = result(batch.column(0).take(pa.array(plain)), *codec(model).encode([texts[i] for i in plain.tolist()]))
            if own is None:
                own = pa.schema([*done.schema, *moved_arrow])
            yield filled(dict(zip(done.schema.names, done.columns)) | {"kind": pa.array(["done"] * len(plain))}, len(plain), own)
            if not len(hit):
                continue
            data = layout.data
            text_of, h = layout.text[hit], layout.digests[hit]
            first, second, second_last, last = (x[hit] for x in (layout.first, layout.second, layout.second_last, layout.last))
            new_text = np.concatenate([[True], text_of[1:] != text_of[:-1]])
            rows = row + np.cumsum(new_text) - 1
            row = int(rows[-1]) + 1
            # A window before each chunk, and one behind the last chunk of a text.
            low = np.where(new_text, layout.starts[text_of], np.concatenate([[0], second_last[:-1]]))
            ending = np.concatenate([new_text[1:], [True]])
            strings = [data[a:b] for a, b in zip(low.tolist(), second.tolist())]
            strings += [data[a:b] for a, b in zip(second_last[ending].tolist(), layout.ends[text_of[ending]].tolist())]
            strings += [data[a:b] for a, b in zip(first.tolist(), second.tolist())]
            strings += [data[a:b] for a, b in zip(second_last.tolist(), last.tolist())]
            coded = parts_of(*codec(model).encode(strings))
            k, m = len(hit), int(ending.sum())
            before, behind, begin, end = coded[:k], coded[k : k + m], coded[k + m : 2 * k + m], coded[2 * k + m :]
            starts = np.flatnonzero(new_text).tolist()
            gaps, lengths = [], []
            for t, (i, j) in enumerate(zip(starts, [*starts[1:], k])):
                windows = [*before[i:j], behind[t]]
                gaps.append(np.concatenate(windows).astype("<u4", copy=False).tobytes())
                # Of every window: its ids, those shared with the chunk on its left, and on its right.
                left, right = [0, *(len(e) for e in end[i:j])], [*(len(b) for b in begin[i:j]), 0]
                lengths.append([n for three in zip((len(w) for w in windows), left, right) for n in three])
            head = {"doc_id": batch.column(0).take(pa.array(text_of[new_text])), "row": pa.array(rows[new_text]), "kind": pa.array(["gaps"] * m)}
            head |= {"gaps": pa.array(gaps), "lengths": pa.array(lengths, pa.list_(pa.int32())), "place": pa.array([-1] * m, pa.int32())}
            yield filled(head, m, own)
            place = pa.array(np.arange(k) - np.repeat(starts, np.diff([*starts, k])), pa.int32())
            yield filled({"kind": pa.array(["ref"] * k), "row": pa.array(rows), "place": place, "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1])}, k, own)
            if len(sent) > REMEMBERED:
                sent = set()
            fresh = []
            for i, key in enumerate(map(tuple, h.tolist())):
                if key not in sent:
                    sent.add(key)
                    fresh.append(i)
            bodies = [data[a:b].decode() for a, b in zip(first[fresh].tolist(), last[fresh].tolist())]
            yield filled({"kind": pa.array(["chunk"] * len(fresh)), "h1": pa.array(h[fresh, 0]), "h2": pa.array(h[fresh, 1]), "body": pa.array(bodies, pa.string())}, len(fresh), own)

    found = stored(docs.mapInArrow(first_pass, f"doc_id {kind}, {schema}, {moved}"), "chunk-rows")

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", BATCH_BYTES):
            packed = [i.astype("<u4", copy=False).tobytes() for i in parts_of(*codec(model).encode(utf8(batch.column(2))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["h1", "h2", "gaps"])

    # Frequent chunks go to several parts; there are at most PARTS of these chunks.
    most = max(occurrences // PARTS, 1)
    frequent = F.broadcast(shared.where(F.col("n") > most).select("h1", "h2", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    once = found.where("kind = 'chunk'").select("h1", "h2", "body").dropDuplicates(["h1", "h2"])
    coded = once.mapInArrow(encode_chunks, "h1 bigint, h2 bigint, gaps binary").join(frequent, ["h1", "h2"], "left")
    coded = coded.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    refs = found.where("kind = 'ref'").select("h1", "h2", "row", "place").join(frequent, ["h1", "h2"], "left")
    refs = refs.withColumn("part", F.pmod(F.xxhash64("row", "place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    handed = refs.join(coded, ["h1", "h2", "part"])
    empty = {"doc_id": kind, "lengths": "array<int>"}
    parts = found.where("kind = 'gaps'").select("row", "place", "doc_id", "lengths", "gaps")
    parts = parts.union(handed.select("row", "place", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "gaps"))
    dealt = parts.repartition("row").sortWithinPartitions("row", "place")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, agree, size = [], [], [], 0
        held: dict | None = None
        for batch in batches:
            for place, doc, lengths, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                own = np.frombuffer(ids, dtype="<u4")
                if place < 0:
                    held = {"doc": doc, "lengths": np.array(lengths).reshape(-1, 3), "gaps": own, "chunks": []}
                else:
                    held["chunks"].append(own)
                if len(held["chunks"]) == len(held["lengths"]) - 1:
                    joined = join_chunks(held["gaps"], held["lengths"], held["chunks"])
                    doc_ids.append(held["doc"])
                    agree.append(joined is not None)
                    texts.append(joined if joined is not None else own[:0])
                    size += len(texts[-1])
                    if size > BATCH_BYTES // 4:
                        yield result(pa.array(doc_ids, doc_type), *together(texts), {"agree": pa.array(agree)})
                        doc_ids, texts, agree, size = [], [], [], 0
        if doc_ids:
            yield result(pa.array(doc_ids, doc_type), *together(texts), {"agree": pa.array(agree)})

    def together(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(arrays), np.cumsum([len(a) for a in arrays], dtype=np.int64)

    doc_type = pa.schema(_arrow_type(docs, "doc_id")).field("doc_id").type
    joined = stored(dealt.mapInArrow(assemble, f"doc_id {kind}, {schema}, agree boolean"), "chunk-joined")
    complete = found.where("kind = 'done'").select(names).union(joined.where("agree").select(names))
    apart = joined.where("NOT agree").select("doc_id").distinct()
    if apart.isEmpty():
        return complete
    # All rows of such an id are encoded whole, the others of it are left out of what was joined.
    null_safe = docs["doc_id"].eqNullSafe(apart["doc_id"])
    return complete.join(apart, complete["doc_id"].eqNullSafe(apart["doc_id"]), "left_anti").union(
        docs.join(apart, null_safe, "left_semi").mapInArrow(whole, f"doc_id {kind}, {schema}")
    )


def _arrow_type(df: DataFrame, name: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(name).schema)


def join_chunks(gaps: np.ndarray, lengths: np.ndarray, chunks: list[np.ndarray]) -> np.ndarray | None:
    """The ids of a text: windows and chunks in turn, without the ids at the ends of the windows that the chunks
    begin or end with as well; None where these do not agree exactly."""
    out = []
    at = 0
    for i, (n, left, right) in enumerate(lengths.tolist()):
        window = gaps[at : at + n]
        at += n
        if left and not np.array_equal(window[:left], chunks[i - 1][-left:]):
            return None
        if right and not np.array_equal(window[n - right :], chunks[i][:right]):
            return None
        if left + right > n:
            return None
        out.append(window[left : n - right])
        if i < len(chunks):
            out.append(chunks[i])
    return np.concatenate(out)
