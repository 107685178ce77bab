"""Chunk reuse against the tokenizers library on whole texts, and its parts by themselves."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe_chunks, common
from shelfmark.llm.common import table

MODEL = bpe_chunks.read_model()
OTHER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, kind string, row long, place int, h1 long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA).repartition(4)


def library(model, texts):
    own = Tokenizer.from_str(model)
    ids = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [own.decode(i, skip_special_tokens=False) for i in ids]


def same(df, model, rows):
    got = sorted(((r["doc_id"], list(r["ids"]), r["n_tokens"], r["decoded"]) for r in df.collect()), key=str)
    ids, texts = library(model, [t for _, t in rows])
    assert got == sorted(((d, i, len(i), t) for (d, _), i, t in zip(rows, ids, texts)), key=str)


def passages(seed, n):
    rng = random.Random(seed)
    words = ["the", "Don't", "naïve", "x1", "<|endoftext|>", "é", "́", "été,", "été.", " ", "日本語", "--", "İ", "e\n", "\t", "12,5"]
    some = [" ".join(rng.choices(words, k=rng.choice([5, 200, 900]))) for _ in range(n)]
    return rng, some


@pytest.mark.parametrize("path", [bpe_chunks.MODEL_PATH, OTHER])
def test_shared_passages(spark, path):
    model = bpe_chunks.read_model(path)
    assert bpe_chunks.cuttable(model)
    rng, some = passages(1, 6)
    rows = [(i, rng.choice(["", " ", "x", "\n\n", "12"]).join(rng.choices(some, k=rng.choice([1, 2, 4])))) for i in range(60)]
    rows += [(None, None), (100, ""), (101, " \n\t"), (102, "a" * 30_000), (103, "word" * 3000 + some[2]), *rows[:4]]
    df = frame(spark, rows)
    shared, n = bpe_chunks.shared_chunks(df)
    assert shared.count() > 3 and n > 100
    same(bpe_chunks.encode(df, model), model, rows)


def test_a_full_filter_moves_more_and_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "digest_filter", lambda shared, a, b: np.full(1 << (common.FILTER_BITS - 6), 2**64 - 1, dtype=np.uint64))
    rng, some = passages(2, 10)
    rows = [(i, " ".join(rng.sample(some, 2))) for i in range(20)]
    same(bpe_chunks.encode(frame(spark, rows), MODEL), MODEL, rows)


def test_documents_whose_chunks_do_not_agree_are_encoded_whole(spark, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "join_chunks", lambda gaps, lengths, chunks: None)
    rng, some = passages(3, 4)
    rows = [(i % 15, some[i % 4] * 3) for i in range(20)] + [(None, some[0] * 3), (50, "short")]
    same(bpe_chunks.encode(frame(spark, rows), MODEL), MODEL, rows)


def test_other_tokenizers_are_not_cut(spark):
    model = MODEL.replace('"invert": true', '"invert": false').replace('"invert":true', '"invert":false')
    assert model != MODEL and not bpe_chunks.cuttable(model)
    assert not bpe_chunks.cuttable(MODEL.replace('"type": "Lowercase"', '"type": "Strip"').replace('"type":"Lowercase"', '"type":"Strip"'))


def test_disagreement_is_seen():
    a, b = np.array([1, 2, 3], dtype="<u4"), np.array([7, 8, 9], dtype="<u4")
    window = [5, 1, 3, 40, 7, 9]
    lengths = np.array([[2, 0, 1], [3, 1, 1], [1, 1, 0]])
    assert bpe_chunks.join_chunks(np.array(window, dtype="<u4"), lengths, [a, b]).tolist() == [5, 1, 2, 3, 40, 7, 8, 9]
    assert bpe_chunks.join_chunks(np.array([5, 1, 4, 40, 7, 9], dtype="<u4"), lengths, [a, b]) is None
    assert bpe_chunks.join_chunks(np.array([5, 2, 3, 40, 7, 9], dtype="<u4"), lengths, [a, b]) is None


def test_chunks_are_cut_by_content():
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(800)).encode()
    layouts = [bpe_chunks.Layout([b"", b"some other words " * i, b"x" * i + passage, passage[i:]]) for i in (3, 50, 171)]
    counts = collections.Counter(bytes(d) for layout in layouts for d in layout.digests)
    assert sum(n >= 5 for n in counts.values()) >= 5
    for layout in layouts:
        for a, b, c, d, t in zip(layout.first, layout.second, layout.second_last, layout.last, layout.text):
            assert layout.starts[t] < a < b <= c < d < layout.ends[t]


def test_empty_table_and_decode(spark):
    assert bpe_chunks.encode(frame(spark, []), MODEL).count() == 0
    rows = [(1, "Hello <|endoftext|> world"), (2, "")]
    ids, texts = library(MODEL, [t for _, t in rows])
    tokens = bpe_chunks.encode(frame(spark, rows), MODEL)
    got = dict(map(tuple, bpe_chunks.decode(tokens.unionByName(tokens.limit(1).withColumns({"doc_id": F.lit(3), "ids": F.lit(None)})), MODEL).collect()))
    assert got == {1: texts[0], 2: "", 3: ""}


def test_digests_of_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe_chunks.encode(docs, MODEL, bpe_chunks.digests(MODEL)).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for (d, _), i, t in zip(rows, *library(MODEL, [t for _, t in rows])):
        assert found[d] == (len(i), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(found) == len(rows)
