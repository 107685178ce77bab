"""Files, rules, issues, batches, the index and its stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.functions import paths
from shelfmark.operators import embedding, evaluation, filters, index as index_ops, outline, path_match
from shelfmark.plans import pipelines, views
from shelfmark.sources import batches, benchmark, files, issues, rules
from shelfmark.streaming.upsert import stream_upsert


@pytest.fixture()
def tree(tmp_path):
    contents = {
        "pkg/__init__.py": b"x = 1\r\ny = 2\r",
        "pkg/_private.py": "é = 1\n".encode(),
        "pkg/empty.py": b"",
        "pkg/bad.txt": b"\xff\xfe\x00",
        "vendor/lib.py": b"v\n",
        "pkg/DATA.JSON": b"{}",
        ".git/config": b"secret",
        "pkg/.hidden.py": b"secret",
    }
    for name, data in contents.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "root/pkg/_private.py", tmp_path / "root/pkg/link.py")
    return str(tmp_path / "root")


def names(df):
    return sorted(r.file_path for r in df.collect())


def test_scan_files(spark, tree):
    df = files.scan_files(spark, tree, "o/r", host="https://h", branch="b")
    assert names(df) == ["o/r/pkg/DATA.JSON", "o/r/pkg/__init__.py", "o/r/pkg/_private.py", "o/r/vendor/lib.py"]
    row = df.filter("file_path like '%init%'").first()
    assert row.content == "x = 1\ny = 2\n" and row.url == "https://h/o/r/blob/b/pkg/__init__.py"


def test_scan_with_rules_equals_filter(spark, tree):
    lines = "# c\n\next:.json\ndir:vendor\nfile:_private.py\nwhat:ever\n"
    path = os.path.join(os.path.dirname(tree), "rules.txt")
    with open(path, "w") as f:
        f.write(lines)
    good, bad = rules.load_rules(spark, path)
    assert sorted(tuple(r) for r in good.collect()) == [("dir", "vendor"), ("ext", ".json"), ("file", "_private.py")]
    assert [r.line for r in bad.collect()] == ["what:ever"]
    scanned = names(files.scan_files(spark, tree, "o/r", exclude=good))
    assert scanned == ["o/r/pkg/__init__.py"]
    everything = files.scan_metadata_only(spark, tree, "o/r")
    excluded = filters.filter_exclude(everything, good)
    assert names(excluded) == names(files.scan_metadata_only(spark, tree, "o/r", exclude=good))
    assert names(filters.filter_include(everything, good)) == names(files.scan_metadata_only(spark, tree, "o/r", include=good))
    with pytest.raises(ValueError):
        files.scan_files(spark, tree, "o/r", include=good, exclude=good)


def test_many_rules_take_the_join(spark, sf_dir, monkeypatch):
    paths_ = views.files_v(spark, sf_dir)
    some = views.rules(spark, views.EXCLUDE_RULES)
    literal = names(filters.filter_exclude(paths_, some)), names(filters.filter_include(paths_, some))
    audit = filters.filter_audit(paths_, exclude=some)
    monkeypatch.setattr(filters, "LITERAL_RULES", 1)
    assert audit.exceptAll(filters.filter_audit(paths_, exclude=some)).isEmpty()
    assert literal == (names(filters.filter_exclude(paths_, some)), names(filters.filter_include(paths_, some)))


def test_default_rules(spark):
    found = rules.default_rules(spark)
    assert found.distinct().count() == found.count()
    assert {r.kind for r in found.collect()} == set(rules.KINDS)
    paths_ = spark.createDataFrame([("o/r/a.py",), ("o/r/node_modules/x.js",), ("o/r/p.png",), ("o/r/yarn.lock",)], "file_path string")
    kept = filters.filter_exclude(paths_.withColumn("namespace", F.lit("o/r")), found)
    assert names(kept) == ["o/r/a.py"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a/.x",), ("a/x",), ("A.PY",)], "p string")
    rows = df.select(paths.extension(F.col("p")).alias("e")).collect()
    assert [r.e for r in rows] == [".gz", "", "", ".py"]


def test_scan_issues_from_json(spark, tmp_path):
    rows = [
        {"url": "u1", "html_url": "h1", "title": "t", "body": None},
        {"url": "u2", "html_url": "h2", "title": "t", "body": "b", "pull_request": {"url": "p"}},
        {"url": "u3", "html_url": "h3", "title": "t", "body": "b"},
    ]
    comments = [
        {"issue_url": "h3", "pos": 2, "body": "second", "url": "c2", "html_url": "h3#2"},
        {"issue_url": "h3", "pos": 1, "body": "first", "url": "c1", "html_url": "h3#1"},
    ]
    for name, data in (("issues", rows), ("comments", comments)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, data)))
    raw = issues.read_issue_json(spark, str(tmp_path / "issues.json"))
    found = issues.scan_issues(raw, issues.read_comment_json(spark, str(tmp_path / "comments.json"))).orderBy("url").collect()
    assert [(r.url, r.body, [c.body for c in r.comments]) for r in found] == [
        ("u1", "", []), ("u3", "b", ["first", "second"])
    ]
    assert issues.scan_issues(raw, max_issues=1).count() == 1


def test_benchmark_and_predictions(spark, tmp_path):
    items = [{"q": "one", "gold": ["a", "b"], "answer": "x"}, {"q": "two", "gold": ["c"]}]
    (tmp_path / "b.json").write_text(json.dumps(items))
    queries, qrels = benchmark.scan_benchmark(benchmark.read_benchmark_json(spark, str(tmp_path / "b.json"), "q", "gold"), 1)
    assert [r.question for r in queries.collect()] == ["one"]
    assert sorted(r.doc_id for r in qrels.collect()) == ["a", "b"]
    (tmp_path / "q.csv").write_text('id,question\n1,"a, ""b"""\n')
    assert tuple(benchmark.scan_question_csv(spark, str(tmp_path / "q.csv")).first()) == ("1", 'a, "b"')
    hits = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (7, "z", 3), (7, "w", 4)], "query_id long, doc_id string, rank int")
    benchmark.write_predictions_csv(hits, str(tmp_path / "out"))
    back = spark.read.option("escape", '"').csv(str(tmp_path / "out"), header=True).first()
    assert tuple(back) == ("7", '["x","y","z"]')


def test_batch_request_and_result_files(spark, tmp_path):
    batched = spark.createDataFrame([("n/0", 1, "b"), ("n/0", 0, "a")], "batch_id string, pos int, text string")
    batches.write_batch_requests(batches.batch_requests(batched, "text-embedding-3-small", 2), str(tmp_path / "req"))
    request = json.loads(spark.read.text(str(tmp_path / "req")).first().value)
    assert request["body"] == {"model": "text-embedding-3-small", "input": ["a", "b"], "dimensions": 2}
    old = batches.batch_requests(batched, "text-embedding-ada-002", 2).first().request
    assert "dimensions" not in json.loads(old)["body"]
    data = [{"index": 1, "embedding": [0.5]}, {"index": 0, "embedding": [0.25]}]
    (tmp_path / "res.json").write_text(json.dumps({"custom_id": "n/0", "response": {"body": {"data": data}}}))
    joined = batches.join_batch_results(batched, batches.read_batch_results(spark, str(tmp_path / "res.json")))
    assert sorted((r.text, r.embedding) for r in joined.collect()) == [("a", [0.25]), ("b", [0.5])]


class Model:
    """Fails on its first calls in each worker process, and always for the word poison."""

    calls = 0

    def __call__(self, texts):
        Model.calls += 1
        if any("poison" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]


def test_embedder_errors_become_rows(spark):
    df = spark.createDataFrame([(i, "poison" if i == 5 else "x" * i) for i in range(20)], "id long, text string").coalesce(1)
    good, bad = embedding.split_errors(embedding.embed_chunks(df, Model(), batch_size=4, attempts=2, first_pause=0))
    assert sorted(r.id for r in bad.collect()) == [4, 5, 6, 7]
    assert {r.id: r.embedding for r in good.collect()}[9] == [9.0]
    assert bad.first().error == "RuntimeError: no"


def test_calls_of_an_embedder_hold_both_limits(spark):
    costs = [5, 5, 90, 5, 5, 5, 200, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, "x", c) for i, c in enumerate(costs)], "id long, text string, num_tokens int").coalesce(1)
    sizes = lambda texts: [[float(len(texts))] for _ in texts]
    found = embedding.embed_chunks(df, sizes, batch_size=4, max_tokens=100).collect()
    assert [int(r.embedding[0]) for r in sorted(found)] == [3, 3, 3, 3, 3, 3, 1, 4, 4, 4, 4, 1]


def test_index_versions_and_stream(spark, sf_dir, tmp_path):
    e = views.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("n"), (F.col("label") % 2).cast("string")).alias("namespace"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        "embedding",
        F.lit(1).alias("num_tokens"),
    )
    newer = e.filter("namespace = 'n1'").withColumn("num_tokens", F.lit(2))
    index = index_ops.Index(spark, str(tmp_path), "one")
    index.upsert(e, 0)
    index.upsert(newer, 1)
    index.upsert(newer, 1)
    assert {(r.namespace, r.num_tokens) for r in index.read().collect()} == {("n0", 1), ("n1", 2)}
    assert index.read().count() == e.count()
    plan = index.versions().filter("namespace = 'n1'")._jdf.queryExecution().executedPlan().toString()
    assert "namespace" in plan.split("PartitionFilters: [")[1].split("]")[0]
    small = index.compact(str(tmp_path), "two")
    assert small.read("n1").count() == newer.count()

    e.repartition(6).write.parquet(str(tmp_path / "landing"))
    newer.write.mode("append").parquet(str(tmp_path / "landing2"))
    streamed = index_ops.Index(spark, str(tmp_path), "three")
    for n, source in enumerate(("landing", "landing2")):
        stream_upsert(
            spark, str(tmp_path / source), e.schema, streamed, str(tmp_path / f"progress{n}"), 1 + 100 * n, max_files=2
        ).awaitTermination()
    columns = ["namespace", "chunk_id", "num_tokens", "embedding"]
    assert streamed.read().select(columns).exceptAll(index.read().select(columns)).isEmpty()
    assert streamed.read().count() == index.read().count()


def test_empty_and_repeated_index(spark, tmp_path):
    index = index_ops.Index(spark, str(tmp_path), "none")
    assert index.commits() == [] and index.read().isEmpty()
    rows = spark.createDataFrame([("n", "a", 1), ("n", "a", 2), ("m", "a", 3)], "namespace string, chunk_id string, num_tokens int")
    index.upsert(rows, 3)
    assert index.commits() == [3]
    assert sorted((r.namespace, r.num_tokens) for r in index.read().collect()) == [("m", 3), ("n", 2)]
    plan = index.read("n").select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<chunk_id:string>" in plan


def test_audit_is_written_per_namespace(spark, sf_dir, tmp_path):
    audit = filters.filter_audit(views.files_v(spark, sf_dir), include=views.rules(spark, views.INCLUDE_RULES))
    filters.write_audit(audit, str(tmp_path / "audit"))
    back = spark.read.text(str(tmp_path / "audit"))
    assert back.count() == audit.count()
    assert back.filter("included = 'true'").count() == audit.filter("included").count() > 0


def test_newest_is_independent_of_order(spark):
    rows = [("n", "a", 2, "x"), ("n", "a", 2, "y"), ("n", "a", 1, "z")]
    schema = "namespace string, id string, version int, v string"
    for some in (rows, rows[::-1]):
        found = index_ops.newest(spark.createDataFrame(some, schema).repartition(3), ["namespace", "id"], "version")
        assert [tuple(r) for r in found.collect()] == [("n", "a", 2, "y")]


def test_build_index_from_a_tree(spark, tree, tmp_path):
    index = index_ops.Index(spark, str(tmp_path), "code")
    left_out = spark.createDataFrame([("dir", "vendor"), ("ext", ".json"), ("file", "__init__.py")], "kind string, value string")
    pipelines.build_index(
        index, files=files.scan_files(spark, tree, "o/r"), issues=None, max_tokens=50, exclude=left_out
    )
    rows = index.read("o/r").collect()
    assert sorted(r.file_path for r in rows) == ["o/r/pkg/_private.py"]
    assert len(rows[0].embedding) == 64 and rows[0].url.endswith("/pkg/_private.py")
    with pytest.raises(ValueError):
        pipelines.index_rows(None, None, 50)


def test_failed_chunks_are_kept_apart(spark, tmp_path):
    rows = [("o/r", "o/r/a.txt", "fine"), ("o/r", "o/r/b.txt", "poison")]
    corpus = spark.createDataFrame(rows, "namespace string, file_path string, content string")

    def model(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0] for _ in texts]

    index = pipelines.build_index(
        index_ops.Index(spark, str(tmp_path), "i"),
        files=corpus,
        issues=None,
        max_tokens=50,
        embedder=model,
        batch_size=1,
        attempts=2,
        first_pause=0.0,
    )
    assert [r.file_path for r in index.read().collect()] == ["o/r/a.txt"]
    errors = spark.read.parquet(f"{index.path}.errors").collect()
    assert [(r.file_path, r.error) for r in errors] == [("o/r/b.txt", "RuntimeError: no")]


def test_outline_variants(spark):
    f = spark.createDataFrame([("o/r", "o/r/a/m.py"), ("o/r", "o/r/z.md")], "namespace string, file_path string")
    s = spark.createDataFrame(
        [("o/r", "o/r/a/m.py", "C", None), ("o/r", "o/r/a/m.py", "C", "run"), ("o/r", "o/r/a/m.py", "C", "_no"), ("o/r", "o/r/a/m.py", None, "top")],
        "namespace string, file_path string, class_name string, method_name string",
    )
    full = outline.fit_tree(f, s, 1000).first()
    assert full.variant == "methods"
    assert full.outline.split("\n") == [
        "o", "    r", "        a", "            m.py", "                C", "                    run", "                top", "        z.md"
    ]
    assert outline.fit_tree(f, s, full.n_tokens - 1).first().variant == "classes"
    assert outline.fit_tree(f, s, full.n_tokens - 3).first().variant == "files"
    cut = outline.fit_tree(f, s, 4).first()
    assert (cut.variant, cut.n_tokens, cut.outline) == ("truncated", 4, "o\n    r\n        a\n            m")


def test_report_is_written_per_run(spark, tmp_path):
    hits = spark.createDataFrame([(1, "a", 1.0)], "query_id long, doc_id string, score double")
    qrels = spark.createDataFrame([(1, "a", 1)], "query_id long, doc_id string, relevance int")
    judged = evaluation.join_qrels(hits, qrels)
    report = evaluation.report_json(
        evaluation.per_query(judged, evaluation.relevant_counts(qrels)), judged, {"k": "3"}, "r1"
    )
    evaluation.write_eval_report(report, str(tmp_path / "reports"))
    row = spark.read.json(str(tmp_path / "reports")).first()
    assert row.run_id == "r1" and json.loads(row.report)["hits"][0]["doc_id"] == "a"


def test_links_and_ids_of_versions_and_other_alphabets(spark):
    df = spark.createDataFrame([("o/r/src/é.txt", "o/r"), ("o/r/src/è.txt", "o/r/abc123")], "p string, n string")
    rows = df.select(paths.file_url(F.col("p"), F.col("n")).alias("u"), paths.chunk_id(F.col("p"), F.lit(0), F.lit(3)).alias("i")).collect()
    assert [r.u for r in rows] == ["https://github.com/o/r/blob/main/src/é.txt", "https://github.com/o/r/blob/abc123/src/è.txt"]
    assert rows[0].i != rows[1].i and all(r.i.startswith("o/r/src/.txt~") and r.i.endswith("_0_3") for r in rows)


def test_files_of_two_commits_are_hydrated_apart(spark):
    files_ = spark.createDataFrame([("o/r", "a", "one"), ("o/r/c2", "a", "two")], "namespace string, file_path string, content string")
    chosen = spark.createDataFrame([("o/r/c2", "a", 1)], "namespace string, file_path string, rank int")
    assert [r.content for r in path_match.hydrate_files(chosen, files_).collect()] == ["two"]


def test_questions_without_hits_and_failed_results(spark):
    hits = spark.createDataFrame([(1, "x", 1)], "query_id long, doc_id string, rank int")
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    found = {r.id: r.documents for r in benchmark.predictions(hits, questions=questions).collect()}
    assert found == {1: '["x"]', 2: "[]"}
    good = json.dumps({"custom_id": "n/0", "response": {"body": {"data": [{"index": 0, "embedding": [1.0]}]}}})
    bad = json.dumps({"custom_id": "n/1", "response": {"body": {"error": "x"}}})
    lines = spark.createDataFrame([(good,), (bad,), ("no json",)], "value string")
    assert batches.parse_batch_results(lines).count() == 1
    errors = sorted((r.batch_id or "", r.reason) for r in batches.batch_result_errors(lines).collect())
    assert errors == [("", "no batch result"), ("n/1", "no vectors")]


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Fake())


def test_wide_trees_are_divided_by_the_tasks(spark, tmp_path, monkeypatch):
    wanted = []
    for i in range(60):
        for name in (f"wide/d{i}/a.txt", f"wide/d{i}/deep/b.txt", f"wide/c{i}.txt"):
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x")
            wanted.append(name)
    monkeypatch.setattr(files, "MOST_FOLDERS", 10)
    reader = files.TreeReader({"path": str(tmp_path)})
    shares = reader.partitions()
    assert {name for s in shares for name in [*s.deep, *s.flat]} == {"", "wide"}
    assert sorted(f for s in shares for f in reader._files(s)) == sorted(wanted)
    assert len([s for s in shares if list(reader._files(s))]) > files.TASKS


def test_lines_of_a_large_outline_are_not_sent_by_namespace(spark):
    f = spark.createDataFrame([("o/r", f"o/r/f{i}.py") for i in range(40)], "namespace string, file_path string")
    s = spark.createDataFrame([("o/r", "o/r/f0.py", "C", None)], "namespace string, file_path string, class_name string, method_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = outline.fit_tree(f, s, 20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_nodes_of_outlines_are_cut_from_paths_once(spark):
    names = "namespace string, file_path string, class_name string, method_name string"
    rows = [("n", "a/b.py", "A", None), ("n", "a/b.py", "A", "m"), ("n", "a/b.py", "A", "_m"), ("n", "a/b.py", None, "f"), ("n", "c.py", "B", "_g"), (None, "c.py", "C", None), ("n", "d.py", None, None)]
    s = spark.createDataFrame(rows, names).repartition(2)
    nodes = outline.symbol_nodes(s, True, True)
    assert sorted((r.namespace or "", r.node_path, r.depth, r.name, r.need) for r in nodes.collect()) == [
        ("", "c.py/C", 1, "C", 1), ("n", "a/b.py/A", 2, "A", 0), ("n", "a/b.py/A", 2, "A", 1), ("n", "a/b.py/A/m", 3, "m", 0), ("n", "a/b.py/f", 2, "f", 0)
    ]
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambda" not in plan
    paths = spark.createDataFrame([("n", "a/b.py"), ("n", "a//c"), ("n", ""), (None, "a/b.py"), ("n", "a/b.py")], "namespace string, file_path string")
    above = outline.path_ancestors(paths)
    assert sorted((r.namespace or "", r.node_path, r.depth, r.name) for r in above.collect()) == [
        ("", "a", 0, "a"), ("", "a/b.py", 1, "b.py"), ("n", "", 0, ""), ("n", "a", 0, "a"), ("n", "a/", 1, ""), ("n", "a//c", 2, "c"), ("n", "a/b.py", 1, "b.py")
    ]
    assert above._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_lines_without_tokens_are_counted_with_the_sizes(spark):
    paths = spark.createDataFrame([("n", f"d//{i}.py") for i in range(6)] + [("m", "x.py")], "namespace string, file_path string")
    s = spark.createDataFrame([("n", "d//1.py", "A", None)], "namespace string, file_path string, class_name string, method_name string")
    found = {r.namespace: (r.variant, r.n_tokens, r.outline) for r in outline.fit_tree(paths, s, 4).collect()}
    assert found == {"m": ("methods", 3, "x.py"), "n": ("truncated", 4, "d\n    \n        0.py")}
    empty = outline.fit_tree(paths.limit(0), s.limit(0), 4)
    assert empty.count() == 0
