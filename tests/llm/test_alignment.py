"""Alignment of two tokenizers against a brute-force version with the libraries' own tokens."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import alignment
from shelfmark.llm.common import table

SCHEMA = "doc_id long, text string, row long, n long, pair string"


def brute(rows):
    """``(report rows, pair counts, groups)`` by definition, with all pairs of tokens that end together."""
    a_model = Tokenizer.from_file(alignment.BYTE_BPE_PATH)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_PATH)
    byte = alignment._byte_of_character()
    docs, counts = [], collections.Counter()
    for doc, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            piece = b_model.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode())
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append((doc, 0, 0, [], ""))
            continue
        ends = []
        for ids, own in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i, x in zip(ids, own):
                at += len(x)
                out.append((at, i))
            ends.append(out)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(a) < 200 else None
        if links is None:
            of = collections.defaultdict(list)
            for f, j in ends[1]:
                of[f].append(j)
            links = [(i, j) for e, i in ends[0] for j in of[e]]
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side if low < e <= cut) for side in ends))
            low = cut
        counts.update(links)
        docs.append((doc, len(a), len(b), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    report = []
    for doc, n_a, n_b, links, groups in docs:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        report.append((doc, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), n_best, sum(counts[x] for x in links), sha))
    return sorted(report, key=str), counts, sorted(((d, g) for d, _, _, _, g in docs), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(df, rows):
    report, counts, groups = brute(rows)
    own = alignment.Alignment(df, *alignment.read_models())
    assert sorted(map(tuple, own.report().select(COLUMNS).collect()), key=str) == report
    assert {(r["a"], r["b"]): r["n"] for r in own.counts().collect()} == dict(counts)
    return groups


def odd_rows():
    rng = random.Random(5)
    parts = ["hello", " world", "naïve café", "日本語のテキスト", "  ", "\n", "\t", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "🙂", "É", "x" * 50, "1234", "ﬁ", " "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (None, "no id"), (204, "\x00 zero"), (205, "é"), *rows[:5]]
    return rows


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 1])
def test_alignment_of_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = odd_rows()
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(3)
    groups = compare(df, rows)
    if frequent == 1:
        found = alignment.token_groups(df, *alignment.read_models())
        assert sorted(map(tuple, found.collect()), key=str) == groups


def test_alignment_of_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    compare(docs, [tuple(r) for r in docs.collect()])


def test_alignment_of_an_empty_table(spark):
    own = alignment.Alignment(spark.createDataFrame([], SCHEMA), *alignment.read_models())
    assert own.report().count() == 0 and own.counts().count() == 0


def test_same_ids_have_the_same_bytes():
    own = alignment.models(*alignment.read_models())
    a, b = own.a_bytes.to_pylist(), own.b_bytes.to_pylist()
    known = [(i, j) for i, j in enumerate(own.same.tolist()) if j >= 0]
    assert len(known) > 5_000 and all(a[i] == b[j] for i, j in known)
    assert {b[j] for j in range(len(b)) if j > 2} & set(a) == {a[i] for i, _ in known} - {b"<unk>", b"<s>", b"</s>"}
