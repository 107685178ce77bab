"""SimHash against all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.components import components
from shelfmark.llm.groups import LEFT, RIGHT, WHOLE, index_pairs


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= bits:
            root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_triples_hold_every_way_to_place_four_bits():
    for pieces in itertools.combinations_with_replacement(range(6), simhash.MAX_BITS):
        assert any(sum(p in t for p in pieces) <= simhash.TRIPLE_BITS for t in simhash.TRIPLES)


def test_anchors_are_all_code_words_in_reach():
    rng = np.random.default_rng(1)
    value = rng.integers(-(2**63), 2**63, 50)
    key, index, owned = simhash.anchors(value)
    assert owned.sum() == 50 * 6 and len(set(zip(key.tolist(), index.tolist()))) == len(key)
    word = key & 0x7FFFFFFF
    assert all(((np.bitwise_count(word & m) & 1) == 0).all() for m in simhash.CHECKS)
    assert set(np.bincount(index)) <= set(range(6, 97))


def test_components_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words)))
        for c in range(rng.randint(0, 4)):
            other = list(words)
            if c:
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((i * 10 + 1 + c, " \t".join(other).upper() if c == 2 else "\n".join(other)))
    rows += [(5001, None), (5000, ""), (5002, " \n "), (7, rows[0][1]), (7, rows[0][1]), (None, rows[0][1]), (6000, "é" * 3000), (6001, "one two")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, fingerprint string, root int, anchor int")
    assert result(simhash.near_duplicates(df)) == plain_components(rows)


def test_crowded_anchors_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**62)
    values = {int(centre)}
    for _ in range(300):
        v = int(centre)
        for b in rng.integers(0, 62, rng.integers(1, 6)):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values | {int(x) for x in rng.integers(0, 2**62, 100)})
    df = spark.createDataFrame([(v,) for v in values], "print long")
    whole = {tuple(r) for r in components(simhash.links(df), "a", "b").collect()}
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    import shelfmark.llm.groups as groups

    monkeypatch.setattr(simhash, "large_keys", lambda s, k, share: groups.large_keys(s, k, share, 8))
    assert {tuple(r) for r in components(simhash.links(df), "a", "b").collect()} == whole
    near = [(a, b) for a, b in itertools.combinations(values, 2) if bin(a ^ b).count("1") <= 4]
    root = {v: v for v in values}
    for _ in range(len(values)):
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    linked = {x for p in near for x in p}
    assert whole == {(v, root[v]) for v in linked}


def test_index_pairs_of_groups_and_tiles():
    side = np.array([WHOLE, WHOLE, WHOLE, LEFT, LEFT, RIGHT, WHOLE])
    found = {(int(a), int(b)) for x, y in index_pairs(np.array([0, 3, 6]), np.array([3, 6, 7]), side) for a, b in zip(x, y)}
    assert found == {(0, 1), (0, 2), (1, 2), (3, 5), (4, 5)}


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e", "k"), (1, "a b c d e", "l"), (1, "a b c d e", "l"), (2, "f g h i j k", "m"), (None, "a b c d e", "n"), (None, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in kept.collect()) == [(0, "n"), (0, "o"), (1, "l"), (2, "m")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


@pytest.mark.parametrize("bits", [-1, 5])
def test_bits_beyond_the_triples_are_refused(spark, bits):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "print long"), bits)
