"""SentencePiece models on the tokenizers library.

The model file is parsed directly (a protocol buffer), and a tokenizer with the same normaliser,
white-space marker, scores and byte fallback is built from it. Unigram models keep their scores;
in models of merges the score of a piece is the priority of the merge that makes it. Batches of whole
texts are encoded in several threads. Each text is also encoded by the sentencepiece library, and its
ids are decoded again; whether the ids agree and whether the text comes back is reported per document.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text that is worked on at a time in a task, in bytes.
BATCH_BYTES = 1_000_000

# Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    raw: bytes = field(default=b"", repr=False)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: ``(number, value)``."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"no SentencePiece model: wire type {wire}")
        yield key >> 3, value


def parse(raw: bytes) -> Model:
    """A model from the bytes of its file."""
    model = Model([], raw=raw)
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind = own.get(3, UNIGRAM)
            model.unk_id = own.get(40, 0)
            model.byte_fallback = bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.add_dummy_prefix = bool(own.get(3, 1))
            model.remove_extra_whitespaces = bool(own.get(4, 1))
            model.escape_whitespaces = bool(own.get(5, 1))
    if model.kind not in (UNIGRAM, MERGES):
        raise ValueError(f"model type {model.kind} is neither unigram nor merges")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a model, best first: every split of a piece into two pieces, by the piece's score,
    then by the number of the piece and of its parts."""
    number = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in number.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in number and b in number:
                found.append((-model.pieces[i][1], i, number[a], number[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model) -> Tokenizer:
    """The model as a tokenizer of the tokenizers library."""
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unk_id][0]
        tokenizer = Tokenizer(models.BPE(vocabulary, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *tail])
    return tokenizer


def spelled(model: Model) -> list[bytes]:
    """The bytes that each piece stands for."""
    pieces = []
    for piece, _, kind in model.pieces:
        pieces.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode())
    return pieces


class Codec:
    """Encodes and decodes lists of texts with one model."""

    def __init__(self, raw: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        self.model = parse(raw)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = spelled(self.model)
        self._pieces = pa.array(pieces, pa.large_binary())
        self._sizes = np.array([len(p) for p in pieces], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids of all texts, ends, parity, round trip)``: ``ends`` has where each text's ids end, ``parity`` whether
        the sentencepiece library gives a whole text the same ids, ``round trip`` whether the decoded ids are
        the text. An empty text has no ids."""
        rows = [e.ids if t else [] for e, t in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), texts)]
        same = np.array([a == b for a, b in zip(rows, self.reference.encode(texts, num_threads=2))], dtype=bool)
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]) if len(ends) else 0)
        exact = np.array([a == b for a, b in zip(self.texts(ids, ends), texts)], dtype=bool)
        return ids, ends, same, exact

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other: what the pieces spell, without the added blank.

        Byte pieces that make no characters are left to the library.
        """
        joined = memoryview(self._pieces.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        places = np.concatenate([[0], np.cumsum(self._sizes[ids])])[np.concatenate([[0], ends])].tolist()
        out = []
        for i, (a, b) in enumerate(zip(places, places[1:])):
            try:
                text = str(joined[a:b], "utf-8")
            except UnicodeDecodeError:
                text = self.decode([ids[ends[i - 1] if i else 0 : ends[i]].tolist()])[0]
            else:
                text = text.removeprefix(" ") if self.model.add_dummy_prefix else text
            out.append(text)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids, by the tokenizers library."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, raw: bytes) -> DataFrame:
    """``(doc_id, ids, n_tokens, n_bytes, parity, round_trip)`` for every row of ``docs(doc_id, text, …)``.

    ``raw`` is the content of a model file. ``parity``: the sentencepiece library gives the whole
    text the same ids. ``round_trip``: the ids, decoded as in :func:`decode`, give the text; not so where the model's
    normaliser changes the text, or the text holds the white-space marker itself.

    * Null and empty texts have no tokens, parity and a round trip.
    * Texts are encoded whole; a batch is cut between rows, a longer text is a batch of its own.
    * Repeated rows give repeated rows; a null ``doc_id`` stays null; other columns are ignored
      whatever their names. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends, same, exact = own.encode(texts)
            ends = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(same),
                    pa.array(exact),
                ],
                ["doc_id", "ids", "n_tokens", "n_bytes", "parity", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, n_tokens bigint, n_bytes bigint, parity boolean, round_trip boolean"
    )


def decode(tokens: DataFrame, raw: bytes) -> DataFrame:
    """``(doc_id, text)`` for every row of ``tokens(doc_id, ids, …)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw)
        for batch in batches:
            texts = own.decode([i or [] for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
