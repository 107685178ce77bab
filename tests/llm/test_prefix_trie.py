"""The conversation trie against a brute-force version, on given and on odd rows, with blocks of few paths."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import prefix_trie
from shelfmark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, least int"


def brute(rows):
    """``{(conv_id, depth): row}`` by definition; rows are ``(conv_id, turn, role, text)``."""

    def order(row):
        role, text = row[2] or "", row[3] or ""
        return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())

    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for prefix, ids in members.items():
        d = len(prefix)
        below = [p for p in members if p[:d] == prefix]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        childless = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == d)))
        children = sum(len(p) == d + 1 for p in below)
        parent = min(members[prefix[:-1]]) if d else None
        out.append((min(ids), d, parent, len(ids), children, childless, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, block=prefix_trie.BLOCK):
    sequences = prefix_trie.rebuilt(df)
    nodes = prefix_trie.prefix_trie(prefix_trie.distinct_paths(sequences), block)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = nodes.select(*columns, F.coalesce("ends", F.lit(prefix_trie.NO_ENDS)))
    return sorted(map(tuple, rows.collect()), key=str)


def random_rows(seed, convs, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn if rng.random() > 0.1 else None, rng.choice(["user", "bot", None]), rng.choice(texts)))
    rows += rng.choices(rows, k=len(rows) // 20)
    return rows


@pytest.mark.parametrize("block", [1, 2, 5, prefix_trie.BLOCK])
def test_trie_of_odd_rows(spark, block):
    texts = ["a", "", None, "é" * 3, "long " * 50]
    rows = random_rows(block, 60, texts) + [(None, 1, "user", "nobody's"), (-7, 0, "user", "a"), (-5, 0, "user", "b")]
    # brute force uses the remainder that SQL has, so negative ids are left to another test
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert found(df, block) == brute(rows)


def test_trie_of_copies_and_turnless_conversations(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 400)] + [(c, 1, "bot", "yes") for c in range(0, 400, 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert found(df, 2) == brute(rows)
    assert prefix_trie.conversation_trie(df.where("conv_id < 0")).count() == 0


def test_long_lists_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 200)
    rows = [(c, 0, "user", "same") for c in range(3000)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert found(df) == brute(rows)


def test_negative_ids_keep_the_sign_of_the_remainder(spark):
    rows = [(-7, 0, "user", "own"), (-5, 0, "user", "lent"), (-7, 1, "user", "more")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = {r["conv_id"]: len(r["sizes"]) for r in prefix_trie.rebuilt(df).collect()}
    h = zlib.crc32(b"-7") % 9
    assert set(got) == {-7, -5} and got[-7] == min(h, 1) + max(2 - h, 0)


def test_trie_of_given_conversations(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert found(df, 7) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
