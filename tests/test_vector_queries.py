"""The queries over ``embeddings`` ask with every vector of the table: rows of their own, none with an id divisible by 20."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from shelfmark.operators import dense
from shelfmark.plans import queries as q
from tests.compare import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()
IDS = [i for i in range(1, 70) if i % 20]
LABELS = [i % 4 for i in IDS]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    v = r.normal(size=(4, 6))[LABELS] + r.normal(size=(len(IDS), 6))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def tables(tmp_path_factory, vectors):
    folder = tmp_path_factory.mktemp("tables")
    types = [pa.int64(), pa.list_(pa.float32()), pa.int32()]
    columns = [pa.array(c, t) for c, t in zip([IDS, vectors.tolist(), LABELS], types)]
    pq.write_table(pa.table(columns, ["vec_id", "embedding", "label"]), folder / "embeddings.parquet")
    return str(folder)


def nearest_ids(vectors, metric):
    """Per id the ids of the nearest others, nearest first."""
    v = vectors.astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, own in enumerate(IDS):
        scores = {"cosine": unit @ unit[i], "dot": v @ v[i], "l2": -np.linalg.norm(v - v[i], axis=1)}[metric]
        out[own] = [d for _, d in sorted((-round(float(s), 12), d) for s, d in zip(scores, IDS) if d != own)][: q.K]
    return out


def hits_of(spark, tables, name):
    found = {}
    for r in QUERIES[name](spark, tables).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    return found


@pytest.mark.parametrize("name, metric", [("topk_cosine", "cosine"), ("topk_dot", "dot"), ("topk_l2", "l2"), ("retrieve_dense", "cosine"), ("knn_cross", "cosine")])
def test_every_vector_is_a_question(spark, tables, vectors, name, metric):
    assert hits_of(spark, tables, name) == nearest_ids(vectors, metric)
    assert differences(spark, connect(tables), QUERIES[name], SQL[name], tables) == []


def test_hits_of_every_vector_are_ranked(spark, tables, vectors):
    assert {i: sorted(d) for i, d in hits_of(spark, tables, "rank_hits").items()} == {i: sorted(d) for i, d in nearest_ids(vectors, "cosine").items()}
    assert differences(spark, connect(tables), QUERIES["rank_hits"], SQL["rank_hits"], tables) == []


def test_blocks_are_not_sent_more_often_than_needed():
    # 51 282 vectors of 64 numbers as questions against themselves, with the sizes of knn_cross.
    n, c = 51_282, 8 * 64 * 51_282
    assert dense.block_counts(c, n, 100_000, 300, 6) == (5, 5)
    # Few rows are not cut any finer than asked for, many no coarser than a task can hold.
    assert dense.block_counts(150_000, 500, 100_000, 300, 6) == (2, 2)
    assert dense.block_counts(20 * dense.QUERY_BYTES, 30 * dense.CORPUS_BLOCK_ROWS, 100_000, 300, 6) == (20, 30)
    assert dense.block_counts(2 * dense.QUERY_BYTES, 0, 2 * dense.QUERY_BYTES - 1, 300, 6) == (2, 1)


def test_block_form_over_many_blocks(spark, tables, vectors, monkeypatch):
    sent = []
    by_blocks = dense._by_blocks
    monkeypatch.setattr(dense, "_by_blocks", lambda *a: sent.append(a[-2:]) or by_blocks(*a))
    corpus = spark.createDataFrame(list(zip(IDS, vectors.tolist())), "doc_id long, embedding array<float>")
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    found = dense.topk_cosine(corpus, asked, q.K, exclude_self=True, query_bytes=48, block_rows=1)
    rows = found.orderBy("query_id", "rank").collect()
    assert {i: [r.doc_id for r in rows if r.query_id == i] for i in IDS} == nearest_ids(vectors, "cosine")
    assert sent[0][0] < len(IDS) / 2 and sent[0][1] < len(IDS) / 2


def expected_metrics(vectors):
    """The six metrics of each id, those of equal labels being relevant."""
    label, out = dict(zip(IDS, LABELS)), {}
    for i, found in nearest_ids(vectors, "cosine").items():
        n = LABELS.count(label[i]) - 1
        rel = [int(label[d] == label[i]) for d in found]
        ranks = [r for r, x in enumerate(rel, 1) if x]
        gain = lambda ranks: sum(1 / math.log2(r + 1) for r in ranks if r <= 3)
        out[i] = {
            "rprec": sum(rel[:n]) / n,
            "p1": rel[0],
            "r3": sum(rel[:3]) / n,
            "ndcg3": gain(ranks) / gain(range(1, n + 1)),
            "map": sum(at / r for at, r in enumerate(ranks, 1)) / n,
            "mrr": 1 / ranks[0] if ranks else 0,
        }
    return out


@pytest.mark.parametrize(
    "name, metric",
    [("eval_rprec", "rprec"), ("eval_p1", "p1"), ("eval_recall3", "r3"), ("eval_ndcg3", "ndcg3"), ("eval_map", "map"), ("eval_mrr", "mrr")],
)
def test_metrics_are_over_every_vector(spark, tables, vectors, name, metric):
    values = [m[metric] for m in expected_metrics(vectors).values()]
    assert QUERIES[name](spark, tables).first()[metric] == pytest.approx(sum(values) / len(IDS), abs=1e-6)
    assert differences(spark, connect(tables), QUERIES[name], SQL[name], tables) == []


def test_the_report_has_every_vector(spark, tables, vectors):
    rows = {r.query_id: r for r in QUERIES["write_eval_report"](spark, tables).collect()}
    expected, near = expected_metrics(vectors), nearest_ids(vectors, "cosine")
    assert sorted(rows) == IDS
    for i, r in rows.items():
        assert [int(d) for d in r.documents.split(",")] == near[i]
        assert [r[m] for m in ("rprec", "map", "mrr")] == pytest.approx([expected[i][m] for m in ("rprec", "map", "mrr")], abs=1e-6)
    assert differences(spark, connect(tables), QUERIES["write_eval_report"], SQL["write_eval_report"], tables) == []
