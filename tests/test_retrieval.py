"""Search, packing and matching against brute force, and the ways taken beyond the size limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.tokens import terms
from shelfmark.functions.vectors import embedding_size
from shelfmark.operators import batching, bm25, dense, evaluation, passages, path_match, ranking, retrieval
from shelfmark.plans import views


def vectors(spark, n, seed, name):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 1)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute(corpus, queries, k, metric):
    out = []
    for q, a in queries:
        a = np.float32(a).astype(float)
        scored = []
        for d, b in corpus:
            b = np.float32(b).astype(float)
            s = {
                "dot": a @ b,
                "cosine": a @ b / np.linalg.norm(a) / np.linalg.norm(b),
                "l2": -np.linalg.norm(a - b),
            }[metric]
            scored.append((-round(float(s), 12), d))
        out += [(q, d, rank + 1) for rank, (_, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", dense.METRICS)
@pytest.mark.parametrize("limit", [dense.QUERY_BYTES, 500])
def test_nearest_is_exact(spark, metric, limit):
    c_rows, corpus = vectors(spark, 300, 1, "doc_id")
    q_rows, queries = vectors(spark, 20, 2, "query_id")
    found = dense.nearest(corpus.repartition(5), queries, 7, metric, query_bytes=limit, block_rows=90)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == brute(c_rows, q_rows, 7, metric)


def test_ties_go_to_the_smaller_id_and_nulls_are_skipped(spark):
    corpus = spark.createDataFrame(
        [(f"d{i}", [1.0, 0.0]) for i in range(50)] + [("x", None)], "doc_id string, embedding array<float>"
    ).repartition(4)
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("n", None)], "query_id string, embedding array<float>")
    found = dense.topk_cosine(corpus, queries, 3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [("q", "d0"), ("q", "d1"), ("q", "d10")]


def test_bm25_beyond_the_broadcast_limit(spark, sf_dir, monkeypatch):
    docs = bm25.term_frame(views.table(spark, sf_dir, "documents"))
    asked = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms")
    )
    one = bm25.topk_bm25(docs, asked, 5).collect()
    given = bm25.topk_bm25(docs, asked, 5, bm25.bm25_fit(docs)).collect()
    monkeypatch.setattr(bm25, "fits", lambda df: False)
    two = bm25.topk_bm25(docs, asked, 5).collect()
    assert sorted(one) == sorted(two) == sorted(given) and len(one) == 200


def test_passages_without_inner_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "Xlph bet"), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame(
        [(1, "lph"), (2, "pha be"), (3, "alpha beta"), (4, ""), (5, "Xl")], "query_id long, passage string"
    )
    for sent in (passages.PASSAGE_BYTES, 0):
        found = sorted(tuple(r) for r in passages.passage_matches(docs, asked, sent).select("query_id", "doc_id").collect())
        assert found == [(1, 1), (1, 2), (2, 1), (3, 1), (5, 2)]


@pytest.mark.parametrize("metric", dense.METRICS)
def test_blocks_that_cannot_serve_are_passed_over(spark, monkeypatch, metric):
    monkeypatch.setattr(dense, "PRUNED_ROWS", 64)
    r = np.random.default_rng(15)
    centers = r.normal(size=(20, 8)) * 5
    rows = [(int(i), (centers[i % 20] + r.normal(size=8) * 0.05).tolist()) for i in range(6000)]
    asked = [(int(i), (centers[i] + r.normal(size=8) * 0.05).tolist()) for i in range(3)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(2)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    found = dense.nearest(corpus, queries, 5, metric)
    assert sorted((x.query_id, x.doc_id, x["rank"]) for x in found.collect()) == brute(rows, asked, 5, metric)
    counts = dense.pruning(corpus, queries, 5, metric).collect()
    blocks, passed = (sum(x[c] for x in counts) for c in ("blocks", "passed"))
    assert blocks > 50 and passed > blocks / 3


@pytest.mark.parametrize("metric", dense.METRICS)
def test_many_queries_in_groups_of_near_ones(spark, monkeypatch, metric):
    for name, value in {"GROUP_ROWS": 16, "PRUNED_ROWS": 32, "PIVOTS": 8, "_TILE": 200, "_PAIRS": 7}.items():
        monkeypatch.setattr(dense, name, value)
    r = np.random.default_rng(16)
    centers = r.normal(size=(12, 8))
    rows = [(f"v{i}", (centers[i % 12] + r.normal(size=8) * 0.3).tolist()) for i in range(300)]
    rows += [(f"longer{i}", rows[i % 5][1]) for i in range(60)] + [("odd", [float("nan")] * 8), ("none", None)]
    corpus = spark.createDataFrame(rows, "doc_id string, embedding array<float>").repartition(3)
    known = [x for x in rows if x[0] not in ("odd", "none")]
    for limit in (dense.QUERY_BYTES, 500):
        found = dense.nearest(corpus, corpus.withColumnRenamed("doc_id", "query_id"), 5, metric, query_bytes=limit, block_rows=90)
        assert sorted((x.query_id, x.doc_id, x["rank"]) for x in found.collect()) == brute(known, known, 5, metric)


def test_distances_of_copies_are_zero(spark):
    one = np.random.default_rng(17).normal(size=64)
    near = one + 1e-5
    rows = [(i, (near if i % 2 else one).tolist()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    found = dense.topk_l2(corpus, corpus.selectExpr("doc_id as query_id", "embedding"), 25, exclude_self=True).collect()
    same = lambda i: [x for x in range(40) if x % 2 == i % 2 and x != i]
    for i in range(40):
        mine = sorted((x["rank"], x.doc_id, x.score) for x in found if x.query_id == i)
        assert [d for _, d, _ in mine[:19]] == same(i) and {s for *_, s in mine[:19]} == {0.0}
        assert {round(s, 10) for *_, s in mine[19:]} == {8e-5}


def test_passages_against_a_search_of_each(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abé ", k=r.randint(1, 5)))
    docs = [(f"d{i}", "".join(word() for _ in range(r.randint(0, 30)))) for i in range(60)] + [("n", None), ("e", "")]
    asked = [(i, word()) for i in range(40)] + [(99, None), (98, ""), (97, "ab"), (96, "ab")]
    found = passages.passage_matches(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "query_id int, passage string"))
    assert sorted(map(tuple, found.collect())) == sorted((q, d) for q, p in asked for d, t in docs if p and t and p in t)


def test_nearly_equal_scores_are_told_apart(spark):
    corpus = [(1, [1.0, 0.0]), (2, [1.0, 4e-4]), (3, [1.0, 1e-4]), (4, [0.0, 1.0])]
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    df = spark.createDataFrame(corpus, "doc_id long, embedding array<double>")
    for metric in ("cosine", "l2"):  # all of 1 to 3 agree to six digits in cosine
        found = dense.nearest(df, queries, 3, metric).orderBy("rank").collect()
        assert [r.doc_id for r in found] == [1, 3, 2]
    one = spark.createDataFrame([(1, i, 1.0, i) for i in range(1, 1001)], "query_id long, doc_id long, score double, rank int")
    fused = ranking.hybrid_rrf(one, one.limit(0), 0.5, 1000).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == list(range(1, 1001))


class Judge:
    """Scores by length, and fails for every call that holds the word poison."""

    def __call__(self, questions, texts):
        if "poison" in texts:
            raise RuntimeError("no")
        return [float(len(t)) for t in texts]


def test_a_failing_scorer_leaves_its_queries_as_retrieved(spark):
    docs = spark.createDataFrame([(i, "poison" if i == 7 else "x" * i) for i in range(12)], "doc_id long, text string")
    rows = [(q, d, float(20 - d), d - 4 * q + 1) for q in range(3) for d in range(4 * q, 4 * q + 4)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")
    asked = spark.createDataFrame([(q, "?") for q in range(3)], "query_id long, question string")
    found = ranking.rerank_topn(hits, asked, docs, 3, model=Judge(), batch_size=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.fell_back) for r in found] == [
        *[(0, d, False) for d in (3, 2, 1)], *[(1, d, True) for d in (4, 5, 6)], *[(2, d, False) for d in (11, 10, 9)]
    ]
    short = ranking.rerank_topn(hits, asked, docs, 3, model=lambda q, t: [1.0], batch_size=4).collect()
    assert all(r.fell_back for r in short)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 3, 10])
def test_nearest_path_is_exact(spark, limit):
    r = random.Random(5)
    name = lambda: "/".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4)))
    paths = sorted({("n" + str(i % 2), name()) for i in range(120)})
    guesses = set()
    for ns, p in r.sample(paths, 50):
        chars = list(p)
        for _ in range(r.randint(0, 8)):
            chars.insert(r.randint(0, len(chars)), r.choice("abc/"))
        guesses.add((ns, "".join(chars)))
    expected = set()
    for ns, g in guesses:
        best = min((distance(g, p), p) for n, p in paths if n == ns)
        if best[0] <= limit:
            expected.add((ns, g, best[1], best[0]))
    found = path_match.nearest_path(
        spark.createDataFrame(sorted(guesses), "namespace string, guess string"),
        spark.createDataFrame(paths, "namespace string, file_path string"),
        limit,
    )
    assert {tuple(x) for x in found.collect()} == expected


def test_validated_paths_are_distinct_and_cut(spark):
    paths = spark.createDataFrame([("o/r", "o/r/a.py"), ("o/r", "o/r/b/c.py")], "namespace string, file_path string")
    rows = [(1, "o/r", i, g) for i, g in enumerate(["sorry, none", "/a.py", "a.py/", "o/r/a.py", "b/cc.py", "r/b/c.py"])]
    guesses = spark.createDataFrame(rows, "query_id long, namespace string, position int, guess string")
    found = path_match.validate_paths(guesses, paths, 2).orderBy("rank").collect()
    assert [(r.file_path, r["rank"]) for r in found] == [("o/r/a.py", 1), ("o/r/b/c.py", 2)]


def chunk_rows(spark, n, namespaces):
    rows = [(namespaces[i % len(namespaces)], f"f{i // 3}", i, 1 + i * 7 % 50) for i in range(n)]
    return spark.createDataFrame(rows, "namespace string, file_path string, start_pos int, num_tokens int")


def test_batches_are_dense(spark):
    rows = batching.assign_batches(chunk_rows(spark, 500, ["a", "a", "b"]), 32).collect()
    for ns in "ab":
        mine = sorted((r.batch_no, r.pos) for r in rows if r.namespace == ns)
        assert mine == [(i // 32, i % 32) for i in range(len(mine))]


@pytest.mark.parametrize("buckets, block_rows, limits", [(3, 1, (10, 120)), (1, 16, (10, 60)), (batching.BUCKETS, 64, (3, 1000)), (2, batching.BLOCK_ROWS, (7, 90))])
def test_budget_batches_are_those_of_a_greedy_walk(spark, buckets, block_rows, limits):
    chunks = chunk_rows(spark, 500, ["a", "a", "b"]).withColumn("text", F.lit("t"))
    rows = batching.token_budget_batches(chunks, *limits, buckets, block_rows=block_rows).collect()
    assert len(rows) == 500
    bucket = {r.file_path: r.b for r in chunks.select("file_path", batching.bucket_of(F.col("file_path"), buckets).alias("b")).distinct().collect()}
    for namespace in ("a", "b"):
        mine = sorted((bucket[r.file_path], r.file_path, r.start_pos, r.num_tokens, r.batch_no, r.pos) for r in rows if r.namespace == namespace)
        no, count, tokens = 0, 0, 0
        for *_, cost, batch_no, pos in mine:
            if count and (count == limits[0] or tokens + cost > limits[1]):
                no, count, tokens = no + 1, 0, 0
            assert (batch_no, pos) == (no, count)
            count, tokens = count + 1, tokens + cost
    assert batching.token_budget_batches(chunks.where("namespace = 'x'"), *limits).count() == 0


@pytest.mark.parametrize("tokens, requests", [(900, 7), (900, 1), (97, 3), (100_000, 5)])
def test_no_minute_exceeds_a_limit(spark, tokens, requests):
    r = random.Random(3)
    rows = [(n, i, f"{n}/{i}", r.choice([1, 40, 333, 450, 451, 800, 1600])) for n in ("a", "b") for i in range(1500 if n == "a" else 40)]
    batches = spark.createDataFrame(rows, "namespace string, batch_no long, batch_id string, n_tokens long")
    found = batching.rate_windows(batches, tokens, requests, buckets=4).collect()
    minutes, last = {}, {}
    for x in found:
        minutes.setdefault(x.minute, []).append(x.n_tokens)
    for sizes in minutes.values():
        assert len(sizes) <= requests and (sum(sizes) <= tokens or len(sizes) == 1)
    assert len(found) == len(rows) and min(minutes) >= 0
    for x in sorted(found, key=lambda x: (x.namespace, x.batch_no)):
        assert x.minute >= last.get(x.namespace, 0)
        last[x.namespace] = x.minute


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame(
        [(1, "a", 3.0), (1, "b", 2.0), (1, "b", 1.0), (1, "c", 0.5), (2, "z", 1.0)],
        "query_id long, doc_id string, score double",
    )
    qrels = spark.createDataFrame(
        [(1, "b", 1), (1, "c", 1), (2, "y", 1), (3, "y", 1)], "query_id long, doc_id string, relevance int"
    )
    judged = evaluation.join_qrels(hits, qrels)
    scores = evaluation.per_query(judged, evaluation.relevant_counts(qrels))
    first = scores.filter("query_id = 1").first()
    gain = 1 / np.log2(3) + 0.5
    assert (first.rprec, first.p1, first.r3, first.mrr) == (0.5, 0.0, 1.0, 0.5)
    assert first.map == pytest.approx((1 / 2 + 2 / 3) / 2) and first.ndcg3 == pytest.approx(gain / (1 + 1 / np.log2(3)))
    report = evaluation.eval_report(scores, "run").first()
    assert report.r3 == pytest.approx(1 / 3, abs=1e-6)


def test_fallback_keeps_the_retrieved_order(spark):
    rows = [(1, "a", 1, 0.1, False), (1, "b", 2, 0.9, False), (2, "a", 1, 0.1, False), (2, "b", 2, None, True)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, rank int, rerank_score double, error boolean")
    found = ranking.rerank_fallback(df, 5).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in found] == ["b", "a", "a", "b"]


def test_hybrid_ends_are_pure(spark):
    hits = lambda rows: ranking.top_k(spark.createDataFrame(rows, "query_id long, doc_id string, score double"), 9)
    d, s = hits([(1, "a", 0.9), (1, "b", 0.1)]), hits([(1, "b", 7.0), (1, "c", 3.0)])
    docs = lambda alpha: [r.doc_id for r in ranking.hybrid_weighted(d, s, alpha, 9).orderBy("rank").collect()]
    assert docs(1.0) == ["a", "b"] and docs(0.0) == ["b", "c"] and docs(0.5) == ["a", "b", "c"]


def test_embedding_sizes(spark):
    models = ["text-embedding-3-large", "voyage-3-lite", "voyage-9", "text-embedding-004", "other"]
    df = spark.createDataFrame([(m,) for m in models], "m string")
    assert [r.s for r in df.select(embedding_size(F.col("m"), 64).alias("s")).collect()] == [3072, 512, 1024, 768, 64]


def test_bm25_deals_documents_to_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    docs = bm25.term_frame(views.table(spark, sf_dir, "documents"))
    asked = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms")
    ).unionByName(spark.createDataFrame([(None, ["the"]), (None, ["of"])], "query_id long, terms array<string>"))
    one = bm25.topk_bm25(docs, asked, 5).collect()
    rows = bm25.postings_join(docs, asked).count()
    monkeypatch.setattr(bm25, "SCORED_ROWS", 500)
    assert bm25.postings_join(docs, asked).rdd.getNumPartitions() == -(-rows // 500) > 16
    two = bm25.topk_bm25(docs, asked, 5).collect()
    key = lambda r: (r.query_id is None, r.query_id, r["rank"])
    assert sorted(one, key=key) == sorted(two, key=key)


def test_compare_runs_reads_each_run_from_one_place(spark, sf_dir, monkeypatch):
    from shelfmark.plans import queries

    labels, stored = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, label: labels.append(label) or stored(df, label))
    assert queries.REGISTRY["compare_runs"](spark, sf_dir).count() == 3 * len(evaluation.METRICS)
    assert [labels.count(name) for name in ("qrels", "sparse", "dense")] == [1, 1, 1]


def test_names_of_files_are_cut_into_words_at_once(spark):
    rows = [("a/MyFile.py", "class FooBar:\n    def get_it2Now(self): pass\ndef top(): pass"), (None, "class A: pass"), ("n.py", None), ("r.md", "class A:"), ("n.py", "x")]
    docs = retrieval.path_documents(spark.createDataFrame(rows, "file_path string, content string"))
    found = sorted(((r.doc_id or "", r.terms) for r in docs.collect()))
    words = ["a", "my", "file", "py", "foo", "bar", "foo", "bar", "get", "it2", "now", "top"]
    assert found == [("", None), ("a/MyFile.py", words), ("n.py", ["n", "py"]), ("n.py", ["n", "py"]), ("r.md", ["r", "md"])]
    paths = spark.range(40).selectExpr("concat('f', id % 4, '.py') AS file_path", "'class A: pass' AS content").distinct()
    plan = retrieval.path_documents(paths)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".pyw") == 1  # the table of extensions is looked up once a file
    assert plan.count("[\\p{L}\\p{N}]+,") == 1  # and all words come from one pattern
