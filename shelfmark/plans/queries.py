"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import languages, paths, tokens, vectors
from ..operators import (
    batching,
    bm25,
    chunking,
    context,
    dense,
    embedding,
    evaluation,
    filters,
    index as index_ops,
    issues as issue_ops,
    jobs as job_ops,
    outline,
    path_match,
    ranking,
    retrieval,
    symbols as symbol_ops,
)
from ..session import scratch_path, stored
from ..sources import batches as batch_io, benchmark as benchmark_io, files as file_io, issues as issue_io, rules as rule_io
from ..streaming.upsert import stream_upsert
from . import pipelines, views

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered queries; the oracle SQL uses the same ones.
TEXT_TOKENS = 200
CODE_TOKENS = 90
ISSUE_TOKENS = 150
BATCH = 16
BATCH_TOKENS = 3000
DEPTH = 25
K = 10
ALPHA = 0.5
OUTLINE_TOKENS = 400


def query(function: Query) -> Query:
    """Register under the function's name, with integers as long, floats as double, and scores shown with six digits."""

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        wide = {T.IntegerType(): "long", T.ShortType(): "long", T.FloatType(): "double"}
        plainly = df.select(
            *[
                F.col(f.name).cast(wide[f.dataType]).alias(f.name) if f.dataType in wide else F.col(f.name)
                for f in df.schema
            ]
        )
        return plainly.withColumn("score", F.round("score", 6)) if "score" in df.columns else plainly

    REGISTRY[function.__name__] = plain
    return function


def spread(df: DataFrame) -> DataFrame:
    """Give a small input that is one file split to all cores; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- inputs ---------------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    return spread(views.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _files(spark, sf_dir) -> DataFrame:
    return views.files_v(spark, sf_dir)


def _paths(spark, sf_dir) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", "namespace", "file_path")


def _questions(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors with their labels, and all of them as queries. A row without an id is neither: no other row is known to
    differ from it."""
    e = views.table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    return (
        spread(e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")),
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
    )


def _issues(spark, sf_dir) -> DataFrame:
    return issue_io.scan_issues(views.issues_raw(spark, sf_dir), views.comments_raw(spark, sf_dir))


def _text_chunks(spark, sf_dir, max_tokens: int = TEXT_TOKENS) -> DataFrame:
    return chunking.chunk_text(spread(_files(spark, sf_dir)), max_tokens)


def _code(spark, sf_dir) -> DataFrame:
    return views.code_v(spark, sf_dir)


def _symbols(spark, sf_dir) -> DataFrame:
    return symbol_ops.extract_symbols(_code(spark, sf_dir))


def _batched(spark, sf_dir) -> DataFrame:
    return batching.assign_batches(stored(_text_chunks(spark, sf_dir), "chunks"), BATCH)


def _terms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = bm25.term_frame(_documents(spark, sf_dir))
    asked = _questions(spark, sf_dir).select("query_id", tokens.terms(F.col("question")).alias("terms"))
    return docs, asked


def _sparse_hits(spark, sf_dir, k: int = DEPTH) -> DataFrame:
    return bm25.topk_bm25(*_terms(spark, sf_dir), k)


def _hit_bound(spark, sf_dir, k: int = DEPTH) -> int:
    return k * _questions(spark, sf_dir).count()


def _dense_docs(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", vectors.hashed_embedding(F.col("text")).alias("embedding"))


def _dense_hits(spark, sf_dir, k: int = DEPTH) -> DataFrame:
    return dense.topk_cosine(_dense_docs(spark, sf_dir), retrieval.embedded_questions(_questions(spark, sf_dir)), k)


def _vector_hits(spark, sf_dir, metric: str = "cosine", k: int = K) -> DataFrame:
    return dense.nearest(*_vectors(spark, sf_dir), k, metric, exclude_self=True)


def _judged(spark, sf_dir, hits: DataFrame) -> DataFrame:
    """Vector hits with relevance 1 for equal labels; the gold pairs are never listed."""
    labels = views.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    d = labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("d_label"))
    return hits.join(q, "query_id").join(d, "doc_id").select(
        "query_id", "doc_id", "score", "rank", (F.col("q_label") == F.col("d_label")).cast("int").alias("relevance")
    )


def _label_totals(spark, sf_dir) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")).filter("n_relevant > 0")
    return e.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")


def _vector_scores(spark, sf_dir, metric: str = "cosine") -> DataFrame:
    judged = _judged(spark, sf_dir, _vector_hits(spark, sf_dir, metric))
    return evaluation.per_query(judged, _label_totals(spark, sf_dir))


def _passage_scores(spark, sf_dir) -> DataFrame:
    qrels = views.qrels_v(spark, sf_dir)
    judged = evaluation.join_qrels(_sparse_hits(spark, sf_dir), qrels)
    return evaluation.per_query(judged, evaluation.relevant_counts(qrels))


# --- A. scans, sources, sinks -----------------------------------------------------------


def _namespaced(files: DataFrame) -> DataFrame:
    """Files of a tree of several repositories, whose first two folders are the namespace."""
    return files.withColumn("namespace", F.substring_index("file_path", "/", 2))


@query
def scan_files(spark, sf_dir):
    """All files, read back from a tree of them."""
    tree = views.file_tree(spark, sf_dir)
    return _namespaced(file_io.scan_files(spark, tree, "", hidden=True)).select("namespace", "file_path", "content")


@query
def decode_text(spark, sf_dir):
    from ..sources.files import decode_text as decode

    raw = views.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("data"))
    return decode(raw).select("page_id", "content")


@query
def scan_metadata_only(spark, sf_dir):
    """Paths and links of all files of a tree, none of which is opened."""
    tree = views.file_tree(spark, sf_dir)
    files = _namespaced(file_io.scan_metadata_only(spark, tree, "", hidden=True))
    return pipelines.with_urls(files.select("namespace", "file_path")).select("file_path", "url")


@query
def load_rules(spark, sf_dir):
    """Rule lines made from the distinct path parts, with comments, blanks and unknown kinds among them."""
    parts = filters.path_parts(_paths(spark, sf_dir))
    kinds = {"ext": F.array("ext"), "dir": F.col("dirs"), "name": F.array("file_name")}
    lines = None
    for kind, values in kinds.items():
        some = parts.select(F.explode(values).alias("v")).select(F.concat(F.lit(kind + ":"), "v").alias("value")).distinct()
        lines = some if lines is None else lines.unionByName(some)
    commented = lines.select(F.concat(F.lit("# "), "value").alias("value"))
    rules, _ = rule_io.parse_rules(lines.unionByName(commented))
    return rules


@query
def scan_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select(
        "url",
        "html_url",
        "title",
        "body",
        F.size("comments").alias("n_comments"),
        F.array_join(F.transform("comments", lambda c: c["html_url"]), ",").alias("comment_urls"),
    )


@query
def scan_benchmark(spark, sf_dir):
    """The benchmark written as JSON with its gold documents, and read back."""
    gold = views.qrels_v(spark, sf_dir).groupBy("query_id").agg(
        F.collect_list(F.col("doc_id").cast("string")).alias("context_files")
    )
    path = scratch_path(spark, "benchmark")
    _questions(spark, sf_dir).join(gold, "query_id", "left").select("question", "context_files").write.json(path)
    _, qrels = benchmark_io.scan_benchmark(benchmark_io.read_benchmark_json(spark, path, lines=True))
    return qrels


@query
def scan_question_csv(spark, sf_dir):
    """The questions written as CSV and read back."""
    path = scratch_path(spark, "questions")
    rows = _questions(spark, sf_dir).select(F.col("query_id").cast("string").alias("id"), "question")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return benchmark_io.scan_question_csv(spark, path)


@query
def write_predictions_csv(spark, sf_dir):
    """The three best documents of every question of the benchmark, those without any among them."""
    return benchmark_io.predictions(_sparse_hits(spark, sf_dir, 3), questions=_questions(spark, sf_dir))


@query
def write_batch_requests(spark, sf_dir):
    return batch_io.batch_requests(_batched(spark, sf_dir), "text-embedding-3-small", 64)


@query
def read_batch_results(spark, sf_dir):
    return _result_vectors(spark, sf_dir).select("batch_id", "pos", F.size("embedding").alias("n"), F.round(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def _result_vectors(spark, sf_dir) -> DataFrame:
    """The vectors as a service would return them, one JSON line per label, and read back."""
    e = views.table(spark, sf_dir, "embeddings")
    batched = batching.assign_batches(
        e.select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").cast("string").alias("file_path"), "vec_id", "embedding"),
        BATCH,
        order=("vec_id",),
    )
    data = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("index"), "embedding")))
    lines = batched.groupBy("batch_id").agg(data.alias("data")).select(
        F.to_json(
            F.struct(
                F.col("batch_id").alias("custom_id"),
                F.struct(F.struct("data").alias("body")).alias("response"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "results")
    lines.write.text(path)
    return batch_io.read_batch_results(spark, path)


@query
def write_eval_report(spark, sf_dir):
    judged = _judged(spark, sf_dir, _vector_hits(spark, sf_dir))
    scores = evaluation.per_query(judged, _label_totals(spark, sf_dir))
    report = evaluation.report_json(scores, judged, {"metric": "cosine", "k": str(K)}, "cosine")
    path = scratch_path(spark, "report")
    evaluation.write_eval_report(report, path)
    metrics = ("rprec", "map", "mrr")
    written = "query_id bigint, hits array<struct<doc_id:bigint>>, " + ", ".join(f"{m} double" for m in metrics)
    back = spark.read.json(path).select("run_id", F.from_json("report", written).alias("r")).select("run_id", "r.*")
    return back.select(
        "run_id",
        "query_id",
        *[F.round(m, 6).alias(m) for m in metrics],
        F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("documents"),
    )


@query
def filter_audit(spark, sf_dir):
    return filters.filter_audit(_paths(spark, sf_dir), exclude=views.rules(spark, views.EXCLUDE_RULES))


@query
def export_index(spark, sf_dir):
    index = index_ops.Index(spark, scratch_path(spark, "index"), "vectors")
    index.upsert(_versions(spark, sf_dir)[0].drop("version"), 0)
    return index.read().select("namespace", "chunk_id", F.size("embedding").alias("n"))


@query
def load_index(spark, sf_dir):
    root = scratch_path(spark, "index")
    first, second = _versions(spark, sf_dir)
    index = index_ops.Index(spark, root, "vectors")
    index.upsert(first.drop("version"), 0)
    index.upsert(second.drop("version"), 1)
    reopened = index_ops.Index(spark, root, "vectors").compact(root, "compacted")
    return reopened.read().select("namespace", "chunk_id", "num_tokens")


# --- B. projections, filters, predicates ------------------------------------------------


@query
def filter_hidden(spark, sf_dir):
    return filters.filter_hidden(_paths(spark, sf_dir)).select("file_path")


@query
def filter_include(spark, sf_dir):
    return filters.filter_include(_paths(spark, sf_dir), views.rules(spark, views.INCLUDE_RULES)).select("file_path")


@query
def filter_exclude(spark, sf_dir):
    return filters.filter_exclude(_paths(spark, sf_dir), views.rules(spark, views.EXCLUDE_RULES)).select("file_path")


@query
def path_parts(spark, sf_dir):
    return filters.path_parts(_paths(spark, sf_dir)).select(
        "file_path", "ext", "file_name", F.array_join("dirs", ",").alias("dirs")
    )


@query
def file_url(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "file_path", paths.file_url(F.col("file_path"), F.col("namespace"), "https://host.example", "dev").alias("url")
    )


@query
def detect_language(spark, sf_dir):
    return _paths(spark, sf_dir).select("file_path", languages.detect_language(F.col("file_path")).alias("language"))


@query
def route_chunker(spark, sf_dir):
    both = _paths(spark, sf_dir).select("file_path").unionByName(
        views.notebooks_v(spark, sf_dir).select("file_path")
    )
    return both.select("file_path", languages.route_chunker(F.col("file_path")).alias("chunker"))


@query
def drop_stored_text(spark, sf_dir):
    both = index_ops.union_sources(
        _text_chunks(spark, sf_dir), issue_ops.chunk_issue(_issues(spark, sf_dir), ISSUE_TOKENS)
    )
    return chunking.drop_stored_text(both).select("chunk_id", "text")


@query
def filter_failed_jobs(spark, sf_dir):
    good, errors = job_ops.filter_failed_jobs(views.jobs_v(spark, sf_dir))
    return good.select("job_id", F.lit("ok").alias("outcome")).unionByName(
        errors.select("job_id", F.col("reason").alias("outcome"))
    )


@query
def limit_batches(spark, sf_dir):
    return batching.limit_batches(_batched(spark, sf_dir), 2).select("batch_id", "pos", "chunk_id")


@query
def namespace_filter(spark, sf_dir):
    """The namespace of the largest document, found in the data."""
    files = _files(spark, sf_dir)
    wanted = views.table(spark, sf_dir, "documents").agg(
        F.max(F.struct("n_chars", F.concat(F.lit("acme/"), "source").alias("ns"))).alias("m")
    ).select("m.ns").scalar()
    return files.filter(F.col("namespace") == wanted).select("namespace", "file_path")


# --- C. scalar functions ----------------------------------------------------------------


@query
def count_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tokens.count_tokens(F.col("text")).alias("num_tokens"))


@query
def truncate_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tokens.truncate_tokens(F.col("text"), 50).alias("text"))


@query
def chunk_content(spark, sf_dir):
    """The text of every chunk, cut from its file."""
    where = _text_chunks(spark, sf_dir).select("namespace", "file_path", "chunk_id", "start_pos", "end_pos")
    joined = where.join(_files(spark, sf_dir).select("namespace", "file_path", "content"), ["namespace", "file_path"])
    cut = paths.chunk_content(F.col("file_path"), F.col("content"), F.col("start_pos"), F.col("end_pos"))
    return joined.select("chunk_id", cut.alias("text"))


@query
def chunk_id(spark, sf_dir):
    """Ids of whole documents, with the start of the text as a name that is not ASCII."""
    path = F.concat("file_path", F.lit("/"), F.get(F.split("content", " "), F.lit(0)))
    n = F.char_length("content")
    return _files(spark, sf_dir).select(
        "doc_id", paths.chunk_id(path, F.lit(0), n).alias("chunk_id"), n.alias("length")
    )


@query
def issue_text(spark, sf_dir):
    return issue_ops.issue_text(_issues(spark, sf_dir))


@query
def fix_path(spark, sf_dir):
    return views.mangled_v(spark, sf_dir).select(
        "doc_id", paths.fix_path(F.col("guess"), F.col("namespace")).alias("path")
    )


@query
def levenshtein_distance(spark, sf_dir):
    return views.mangled_v(spark, sf_dir).select("doc_id", F.levenshtein("guess", "file_path").alias("distance"))


@query
def normalize_namespace(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    full = paths.namespace_of(F.concat(F.lit("acme/"), "source"), F.concat(F.col("lang"), F.lit(".x")))
    return d.select(
        "doc_id",
        full.alias("namespace"),
        paths.safe_namespace(full).alias("safe"),
        paths.dataset_name(full).alias("dataset"),
    )


@query
def validate_repo_id(spark, sf_dir):
    guess = views.mangled_v(spark, sf_dir)
    repo = F.array_join(F.slice(F.split("guess", "/"), 1, 2), "/")
    return guess.select("doc_id", repo.alias("repo"), paths.is_repo_id(repo).alias("valid"))


@query
def embedding_size(spark, sf_dir):
    """A model per source, sizes by model."""
    names = F.array(*[F.lit(m) for m in [*vectors.MODEL_DIMENSIONS, "voyage-3", "other"]])
    model = F.get(names, (F.col("doc_id") % F.size(names)).cast("int"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", model.alias("model"), vectors.embedding_size(model, 64).alias("size")
    )


@query
def source_links(spark, sf_dir):
    files = pipelines.with_urls(_paths(spark, sf_dir))
    hits = _sparse_hits(spark, sf_dir)
    return context.source_links(
        ranking.with_metadata(hits, files, ["file_path", "url"], _hit_bound(spark, sf_dir))
    )


# --- D. row generators ------------------------------------------------------------------


@query
def chunk_text(spark, sf_dir):
    return _text_chunks(spark, sf_dir).select("chunk_id", "file_path", "start_pos", "end_pos", "num_tokens", "text")


@query
def chunk_code(spark, sf_dir):
    return chunking.chunk_code(_code(spark, sf_dir), CODE_TOKENS).select(
        "file_path", "start_pos", "end_pos", "num_tokens", "text"
    )


@query
def merge_small_chunks(spark, sf_dir):
    chunks = _text_chunks(spark, sf_dir, TEXT_TOKENS // 2)
    return chunking.merge_small_chunks(chunks.drop("url"), TEXT_TOKENS, _files(spark, sf_dir)).select(
        "file_path", "start_pos", "end_pos", "num_tokens", "chunk_id", "text"
    )


@query
def chunk_notebook(spark, sf_dir):
    return chunking.chunk_notebook(views.notebooks_v(spark, sf_dir), CODE_TOKENS).select(
        "file_path", "start_pos", "end_pos", "num_tokens", "text"
    )


@query
def notebook_code(spark, sf_dir):
    return views.notebooks_v(spark, sf_dir).select("file_path", chunking.notebook_code(F.col("content")).alias("code"))


@query
def chunk_issue(spark, sf_dir):
    return issue_ops.chunk_issue(_issues(spark, sf_dir), ISSUE_TOKENS).select(
        "chunk_id", "url", "start_comment", "end_comment", "num_tokens", "text"
    )


@query
def chunk_any(spark, sf_dir):
    return chunking.chunk_any(spread(_files(spark, sf_dir)), TEXT_TOKENS).select(
        "file_path", "chunker", "start_pos", "end_pos", "num_tokens", "text"
    )


@query
def extract_symbols(spark, sf_dir):
    """Symbols of all code, by indentation, braces and ends."""
    found = _symbols(spark, sf_dir).unionByName(symbol_ops.extract_symbols(views.polyglot_v(spark, sf_dir)))
    return found.select("file_path", "class_name", "method_name")


@query
def path_ancestors(spark, sf_dir):
    return outline.path_ancestors(_paths(spark, sf_dir))


# --- E. joins ---------------------------------------------------------------------------


@query
def join_batch_results(spark, sf_dir):
    """The batch of each vector joined to the vectors read back from result lines."""
    e = views.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("namespace"), F.col("vec_id").cast("string").alias("file_path"), "vec_id"
    )
    batched = batching.assign_batches(e, BATCH, order=("vec_id",))
    joined = batch_io.join_batch_results(batched, _result_vectors(spark, sf_dir))
    return joined.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query
def join_issue_comments(spark, sf_dir):
    issues = issue_io.join_issue_comments(
        views.issues_raw(spark, sf_dir).select("html_url", "title"), views.comments_raw(spark, sf_dir)
    )
    return issues.select(
        "html_url", F.array_join(F.transform("comments", lambda c: c["body"]), "|").alias("bodies")
    )


def _guesses(spark, sf_dir) -> DataFrame:
    """One question per namespace; its guesses are that namespace's mangled paths."""
    return views.mangled_v(spark, sf_dir).select(
        F.col("namespace").alias("query_id"), "namespace", F.col("doc_id").alias("position"), "guess"
    )


@query
def validate_paths(spark, sf_dir):
    return path_match.validate_paths(_guesses(spark, sf_dir), _paths(spark, sf_dir)).select(
        "query_id", "file_path", "rank"
    )


@query
def nearest_path(spark, sf_dir):
    guesses = views.mangled_v(spark, sf_dir).select(
        "namespace", paths.fix_path(F.col("guess"), F.col("namespace")).alias("guess")
    )
    return path_match.nearest_path(guesses, _paths(spark, sf_dir))


@query
def join_qrels(spark, sf_dir):
    return evaluation.join_qrels(_sparse_hits(spark, sf_dir), views.qrels_v(spark, sf_dir))


@query
def hydrate_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    bound = _hit_bound(spark, sf_dir, 3)
    best = ranking.with_metadata(_sparse_hits(spark, sf_dir, 3), files, ["namespace", "file_path"], bound)
    return path_match.hydrate_files(best.select("query_id", "rank", "namespace", "file_path"), files, bound).select(
        "query_id", "rank", "file_path", "content"
    )


@query
def hydrate_text(spark, sf_dir):
    stored = chunking.drop_stored_text(_text_chunks(spark, sf_dir))
    return chunking.hydrate_text(stored, _files(spark, sf_dir)).select("chunk_id", "text")


@query
def postings_join(spark, sf_dir):
    return bm25.postings_join(*_terms(spark, sf_dir)).select(
        "query_id", "doc_id", "term", F.round("weight", 6).alias("weight")
    )


@query
def knn_cross(spark, sf_dir):
    """The same search with both sides cut into blocks, as for query sets that cannot be broadcast."""
    corpus, queries = _vectors(spark, sf_dir)
    return dense.topk_cosine(corpus, queries, K, exclude_self=True, query_bytes=100_000, block_rows=300)


# --- F. aggregations --------------------------------------------------------------------


@query
def job_status_counts(spark, sf_dir):
    return job_ops.job_status_counts(views.jobs_v(spark, sf_dir))


@query
def all_jobs_ready(spark, sf_dir):
    return job_ops.all_jobs_ready(views.jobs_v(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    return outline.corpus_stats(_text_chunks(spark, sf_dir))


@query
def bm25_fit(spark, sf_dir):
    stats = bm25.bm25_fit(bm25.term_frame(_documents(spark, sf_dir)))
    return stats.select(
        "term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"),
        F.round(bm25.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"),
    )


@query
def bm25_encode(spark, sf_dir):
    return bm25.bm25_encode(bm25.term_frame(_documents(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@query
def batch_collect(spark, sf_dir):
    return batching.batch_collect(_batched(spark, sf_dir)).select(
        "batch_id", F.array_join("texts", "\n--\n").alias("texts")
    )


@query
def extension_share(spark, sf_dir):
    ext = filters.path_parts(_paths(spark, sf_dir)).select("doc_id", "ext")
    runs = _sparse_hits(spark, sf_dir).withColumn("run_id", F.lit("sparse")).unionByName(
        _dense_hits(spark, sf_dir).withColumn("run_id", F.lit("dense"))
    )
    return evaluation.extension_share(runs.join(ext, "doc_id"))


@query
def compare_runs(spark, sf_dir):
    """Dense and fused retrieval of the benchmark passages against sparse retrieval, question by question."""
    # Each is read by several runs.
    qrels = stored(views.qrels_v(spark, sf_dir), "qrels")
    sparse, found = stored(_sparse_hits(spark, sf_dir), "sparse"), stored(_dense_hits(spark, sf_dir), "dense")
    runs = {"sparse": sparse, "dense": found, "rrf": ranking.hybrid_rrf(found, sparse, ALPHA, DEPTH)}
    totals = evaluation.relevant_counts(qrels)
    scores = [stored(evaluation.per_query(evaluation.join_qrels(hits, qrels), totals), "run").withColumn("run_id", F.lit(name)) for name, hits in runs.items()]
    return evaluation.compare_runs(reduce(DataFrame.unionByName, scores), "sparse")


# --- G. window functions ----------------------------------------------------------------


@query
def assign_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("chunk_id", "batch_id", "batch_no", "pos")


@query
def token_budget_batches(spark, sf_dir):
    packed = batching.token_budget_batches(_text_chunks(spark, sf_dir), BATCH, BATCH_TOKENS)
    return packed.select("chunk_id", "batch_id", "pos")


@query
def rate_windows(spark, sf_dir):
    sizes = batching.batch_sizes(_batched(spark, sf_dir))
    return batching.rate_windows(sizes, 20_000, 12).select("batch_id", "n_tokens", "tokens_so_far", "requests_so_far", "minute")


@query
def rank_hits(spark, sf_dir):
    """Hits of the three kinds: with a score, with a reranker's score, with a position only."""
    hits = _vector_hits(spark, sf_dir)
    kind = F.col("query_id") % 3
    return ranking.rank_hits(
        hits.select(
            "query_id",
            "doc_id",
            F.when(kind == 0, F.col("score")).alias("score"),
            F.when(kind == 1, -F.col("score")).alias("relevance_score"),
            (F.col("rank") - 1).alias("position"),
        )
    ).select("query_id", "doc_id", "score", "rank")


@query
def history_context(spark, sf_dir):
    return context.history_context(views.table(spark, sf_dir, "conversations"))


# --- H. sorts, limits, top-k ------------------------------------------------------------


@query
def topk_cosine(spark, sf_dir):
    return _vector_hits(spark, sf_dir, "cosine")


@query
def topk_dot(spark, sf_dir):
    return _vector_hits(spark, sf_dir, "dot")


@query
def topk_l2(spark, sf_dir):
    return _vector_hits(spark, sf_dir, "l2")


@query
def topk_bm25(spark, sf_dir):
    return _sparse_hits(spark, sf_dir)


@query
def rerank_topn(spark, sf_dir):
    return ranking.rerank_topn(
        _sparse_hits(spark, sf_dir),
        _questions(spark, sf_dir),
        _documents(spark, sf_dir),
        at_most=_hit_bound(spark, sf_dir),
    ).drop("fell_back")


@query
def limit_instances(spark, sf_dir):
    return benchmark_io.limit_instances(_questions(spark, sf_dir), 10)


# --- I. set operations and index maintenance --------------------------------------------


def _variants(spark, sf_dir) -> DataFrame:
    """Sentences of the questions as their rewrites."""
    q = _questions(spark, sf_dir)
    return q.select("query_id", F.posexplode(F.split("question", r"\. ")).alias("variant_id", "question"))


@query
def multi_query_union(spark, sf_dir):
    variants = _variants(spark, sf_dir).select(
        F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_id").cast("string")).alias("query_id"),
        tokens.terms(F.col("question")).alias("terms"),
    )
    docs, _ = _terms(spark, sf_dir)
    hits = bm25.topk_bm25(docs, variants, K)
    return ranking.multi_query_union(
        hits.withColumn("query_id", F.split_part("query_id", F.lit("#"), F.lit(1)).cast("long"))
    )


@query
def union_sources(spark, sf_dir):
    both = index_ops.union_sources(
        _text_chunks(spark, sf_dir), issue_ops.chunk_issue(_issues(spark, sf_dir), ISSUE_TOKENS)
    )
    return both.select("chunk_id", "file_path", "url", "start_pos", "start_comment", "num_tokens")


@query
def excluded_paths(spark, sf_dir):
    files = _paths(spark, sf_dir)
    return filters.excluded_paths(files, filters.apply_rules(files, include=views.rules(spark, views.INCLUDE_RULES)))


@query
def dedup_chunks(spark, sf_dir):
    chunks = _text_chunks(spark, sf_dir).select("file_path", "start_pos", "end_pos")
    return chunking.dedup_chunks(chunks.unionByName(chunks))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and a second upload of those with a label of 5 or more under a new label."""
    e = views.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("acme/v"), (F.col("vec_id") % 4).cast("string")).alias("namespace"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label").alias("num_tokens"),
        "embedding",
    )
    newer = e.filter("num_tokens >= 5").withColumn("num_tokens", F.col("num_tokens") + 100)
    return e.withColumn("version", F.lit(1)), newer.withColumn("version", F.lit(2))


@query
def upsert_index(spark, sf_dir):
    merged = index_ops.upsert_index(*_versions(spark, sf_dir), ["namespace", "chunk_id"])
    return merged.select("namespace", "chunk_id", "num_tokens", "version")


@query
def stream_upsert_index(spark, sf_dir):
    """The table as a stream into an empty index; equal to the batch upsert of the same rows."""
    root = scratch_path(spark, "stream")
    index = index_ops.Index(spark, root, "vectors")
    first, _ = _versions(spark, sf_dir)
    first.drop("version").write.parquet(f"{root}/landing")
    stream = stream_upsert(
        spark, f"{root}/landing", first.drop("version").schema, index, f"{root}/progress", max_files=2
    )
    stream.awaitTermination()
    return index.read().select("namespace", "chunk_id", "num_tokens")


REGISTRY["stream_upsert"] = REGISTRY.pop("stream_upsert_index")


# --- J. embedding -----------------------------------------------------------------------


@query
def embed_chunks(spark, sf_dir):
    embedded = embedding.embed_chunks(_documents(spark, sf_dir))
    return embedded.select("doc_id", F.posexplode_outer("embedding").alias("dim", "v")).select(
        "doc_id", "dim", F.round(F.col("v").cast("double"), 6).alias("value")
    )


# --- K. retrieval compositions ----------------------------------------------------------


@query
def retrieve_dense(spark, sf_dir):
    return retrieval.retrieve_dense(*_vectors(spark, sf_dir), K, ["label"], exclude_self=True)


@query
def retrieve_sparse(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return retrieval.retrieve_sparse(spread(docs), _questions(spark, sf_dir), DEPTH, ["lang", "source"])


@query
def hybrid_rrf(spark, sf_dir):
    return ranking.hybrid_rrf(_dense_hits(spark, sf_dir), _sparse_hits(spark, sf_dir), ALPHA, DEPTH)


@query
def hybrid_weighted(spark, sf_dir):
    return ranking.hybrid_weighted(_dense_hits(spark, sf_dir), _sparse_hits(spark, sf_dir), ALPHA, DEPTH)


@query
def retrieve_by_path(spark, sf_dir):
    files = _files(spark, sf_dir).select("file_path", "content").unionByName(
        _code(spark, sf_dir).select("file_path", "content")
    )
    return retrieval.retrieve_by_path(files, views.path_questions_v(spark, sf_dir), K)


@query
def rerank_fallback(spark, sf_dir):
    """Reranked hits where the scorer failed for documents in French."""
    hits = _sparse_hits(spark, sf_dir)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pairs = ranking.with_metadata(hits, docs, ["text", "lang"], _hit_bound(spark, sf_dir)).join(
        _questions(spark, sf_dir), "query_id"
    )
    return ranking.rerank_fallback(
        pairs.select(
            "query_id",
            "doc_id",
            "rank",
            ranking.token_overlap(F.col("question"), F.col("text")).alias("rerank_score"),
            (F.col("lang") == "fr").alias("error"),
        )
    )


@query
def build_index(spark, sf_dir):
    index = index_ops.Index(spark, scratch_path(spark, "index"), "corpus")
    issues = _issues(spark, sf_dir).withColumn("namespace", F.lit("acme/chat/issues"))
    pipelines.build_index(
        index,
        files=pipelines.with_urls(spread(_files(spark, sf_dir))),
        issues=issues,
        max_tokens=TEXT_TOKENS,
        exclude=views.rules(spark, views.EXCLUDE_RULES),
    )
    return index.read().select("namespace", "chunk_id", "num_tokens", "text")


# --- L. context assembly ----------------------------------------------------------------


def _tree_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = _paths(spark, sf_dir).select("namespace", "file_path").unionByName(
        views.code_v(spark, sf_dir).select("namespace", "file_path")
    )
    return files, _symbols(spark, sf_dir)


@query
def render_tree(spark, sf_dir):
    return outline.render_tree(*_tree_inputs(spark, sf_dir))


@query
def render_tree_methods_only(spark, sf_dir):
    return outline.render_tree(*_tree_inputs(spark, sf_dir), classes=False)


@query
def fit_tree(spark, sf_dir):
    return outline.fit_tree(*_tree_inputs(spark, sf_dir), OUTLINE_TOKENS)


@query
def standalone_question(spark, sf_dir):
    return context.standalone_question(context.history_context(views.table(spark, sf_dir, "conversations")))


@query
def rag_prompt(spark, sf_dir):
    hits = ranking.with_metadata(
        _sparse_hits(spark, sf_dir, 3), _documents(spark, sf_dir), ["text"], _hit_bound(spark, sf_dir, 3)
    )
    questions = _questions(spark, sf_dir).withColumn("history", F.lit(""))
    return context.rag_prompt(hits, questions)


@query
def picker_prompt(spark, sf_dir):
    outlines = outline.fit_tree(*_tree_inputs(spark, sf_dir), OUTLINE_TOKENS)
    return context.picker_prompt(outlines, views.path_questions_v(spark, sf_dir), K)


# --- M. evaluation ----------------------------------------------------------------------


def _metric_query(metric: str) -> Query:
    return lambda spark, sf_dir: evaluation.mean_of(_vector_scores(spark, sf_dir), metric)


for _key, _metric in zip(
    ("eval_rprec", "eval_p1", "eval_recall3", "eval_ndcg3", "eval_map", "eval_mrr"), evaluation.METRICS
):
    REGISTRY[_key] = _metric_query(_metric)


@query
def eval_report(spark, sf_dir):
    return evaluation.eval_report(_passage_scores(spark, sf_dir), "bm25")
