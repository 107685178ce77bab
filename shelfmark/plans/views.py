"""Views of the given tables that stand for files, issues, source code, gold answers and jobs.

Each is a pure function of the tables; ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.passages import passage_matches
from ..session import scratch_path

OWNER = "acme"
# Folders and extensions that the file view cycles through, and the rule lists for it.
FOLDERS = ["src", "src/core", "tests", "docs", "build", ".github", "src/vendor", "lib"]
EXTENSIONS = [".py", ".md", ".txt", ".ts", ".JSON", ".yaml", ".tsx"]
INCLUDE_RULES = [("ext", ".md"), ("ext", ".Py"), ("file", "__init__.ts"), ("dir", "docs")]
EXCLUDE_RULES = [("ext", ".json"), ("ext", ".yaml"), ("file", "__init__.py"), ("dir", "vendor"), ("dir", "build")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(values: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def rules(spark: SparkSession, values: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(values, "kind string, value string")


def files_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ext = _cycle(EXTENSIONS, d)
    name = F.when(d % 50 == 0, F.concat(F.lit("__init__"), ext)).otherwise(
        F.concat(F.lit("doc_"), d.cast("string"), ext)
    )
    namespace = F.concat(F.lit(OWNER + "/"), "source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        namespace.alias("namespace"),
        F.concat_ws("/", namespace, _cycle(FOLDERS, d), F.concat(F.lit("d"), d.cast("string")), name).alias(
            "file_path"
        ),
        F.col("text").alias("content"),
    )


def mangled_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guessed paths: wrong in one of five ways, or no path at all."""
    files = files_v(spark, sf_dir).drop("content")
    path = F.col("file_path")
    parts = F.split(path, "/")
    from_part = lambda n: F.array_join(F.slice(parts, F.lit(n), F.size(parts)), "/")
    case = F.col("doc_id") % 6
    guess = (
        F.when(case == 0, F.concat(F.lit("/"), path))
        .when(case == 1, from_part(2))
        .when(case == 2, F.concat_ws("/", F.lit(OWNER), from_part(3)))
        .when(case == 3, from_part(3))
        .when(case == 4, F.regexp_replace(path, r"..(\.[^.]*)$", "zz$1"))
        .otherwise("no file fits")
    )
    return files.withColumn("guess", guess)


def issues_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue rows as an API returns them: nullable body, pull requests among them. The title is the first
    line; where the body is null, the whole first text is a comment."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0")
    c = F.col("conv_id")
    return first.select(
        F.concat(F.lit("api/issue/"), c.cast("string")).alias("url"),
        F.concat(F.lit("issue/"), c.cast("string")).alias("html_url"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.when(c % 10 != 0, F.col("text")).alias("body"),
        F.when(c % 7 == 0, F.struct(F.concat(F.lit("api/pull/"), c.cast("string")).alias("url"))).alias(
            "pull_request"
        ),
    )


def comments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.concat(F.lit("issue/"), F.col("conv_id").cast("string"))
    return (
        table(spark, sf_dir, "conversations")
        .filter("turn >= 1 OR conv_id % 10 = 0")
        .select(
            issue.alias("issue_url"),
            F.col("turn").alias("pos"),
            F.concat(F.lit("api/comment/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"),
            F.concat(issue, F.lit("#"), F.col("turn").cast("string")).alias("html_url"),
            F.col("text").alias("body"),
        )
    )


def code_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per order, one method per line number.

    The number of partitions is given, because the keys are small and the texts made from
    them are not: adaptive execution would put all keys of a small table into one task.
    """
    order = F.col("l_orderkey")
    k, n = order.cast("string"), lambda m: m.cast("string")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber")
        .repartition(partitions, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    )

    def method(m: Column) -> Column:
        name = F.concat(F.when((m % 2 == 0) & (order % 5 == 0), F.lit("_hidden_")).otherwise("line_"), n(m))
        nested = F.when(order % 3 == 0, F.lit("        def inner():\n            return 0\n")).otherwise("")
        return F.concat(F.lit("    def "), name, F.lit("(self):\n        return "), n(m), F.lit("\n"), nested)

    helper = F.when(
        order % 2 == 0, F.concat(F.lit("def helper_"), k, F.lit("():\n    return "), k, F.lit("\n"))
    ).otherwise("")
    return keys.select(
        "l_orderkey",
        F.lit(f"{OWNER}/code").alias("namespace"),
        F.concat(F.lit(f"{OWNER}/code/o"), k, F.lit(".py")).alias("file_path"),
        F.concat(
            F.lit("class Order"), k, F.lit(":\n"), F.array_join(F.transform("lines", method), ""), helper
        ).alias("content"),
    )


#: The languages of ``polyglot_v`` by order number: extension, what stands before the members, a member, what
#: stands behind them. ``{k}`` is the order, ``{n}`` the line; comments and strings hold what is no code.
POLYGLOT = [
    (
        ".java",
        "// class Fake{k} {\npublic class Order{k} extends Base {\n    String s = \"} class Wrong {\";\n",
        "    public int line_{n}(int a, List<T> b) throws E {\n        if (a > 0) { return call(a); }\n        return {n};\n    }\n",
        "}\n",
    ),
    (
        ".cs",
        "namespace N\n{\n    /* class Fake{k} { */\n    public class Order{k} : Base\n    {\n        string p = @\"C:\\{\";\n",
        "        public int line_{n}<T>(T a) where T : new()\n        {\n            while (a) { }\n            return {n};\n        }\n",
        "    }\n}\n",
    ),
    (
        ".kt",
        "open class Order{k}(val x: Int) : Base(x) {\n    val s = \"class Wrong {\"\n",
        "    fun line_{n}(a: Int): Int {\n        fun nested() = 1\n        return {n}\n    }\n",
        "}\nfun helper_{k}(a: Int) = a\n",
    ),
    (
        ".scala",
        "// def none = {\nclass Order{k}(x: Int) extends Base {\n",
        "  def line_{n}(a: Int): Int = {\n    def nested = 2\n    {n}\n  }\n",
        "}\ndef helper_{k}(a: Int) = a\n",
    ),
    (
        ".php",
        "<?php\n# class Fake{k} {\nclass Order{k} extends Base {\n",
        "    public function line_{n}($a) {\n        return function($x) { return '}'; };\n    }\n",
        "}\nfunction helper_{k}() { return 1; }\n",
    ),
    (
        ".swift",
        "class Order{k}: Base {\n    let s = \"func none() {\"\n",
        "    func line_{n}(a: Int) -> Int {\n        func nested() { }\n        return {n}\n    }\n",
        "}\nfunc helper_{k}() { }\n",
    ),
    (
        ".go",
        "package main\ntype Order{k} struct {\n    x int\n}\n",
        "func (o *Order{k}) line_{n}(a int) int {\n    s := `} func none() {`\n    return {n}\n}\n",
        "func helper_{k}() { }\n",
    ),
    (
        ".rs",
        "pub struct Order{k} { x: i32 }\nimpl<'a> Order{k} {\n",
        "    pub fn line_{n}(&'a self) -> i32 {\n        let c = '{'; /* fn none() { */\n        {n}\n    }\n",
        "}\nfn helper_{k}() { }\n",
    ),
    (
        ".rb",
        "# class Fake{k}\nclass Order{k} < Base\n",
        "  def line_{n}(a)\n    if a\n      b.each do |x| puts 'end' end\n    end\n    {n}\n  end\n",
        "end\ndef helper_{k}\n  1\nend\n",
    ),
]
#: Languages of it without functions outside of classes.
MEMBERS_ONLY = 2


def polyglot_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order in one of several languages, one method per line number."""
    order = F.col("l_orderkey")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber")
        .repartition(partitions, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    )
    put = lambda text, key, value: F.replace(text, F.lit(key), value.cast("string"))
    which = (order % len(POLYGLOT)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(p[i]) for p in POLYGLOT]), which)
    members = F.array_join(F.transform("lines", lambda n: put(of(2), "{n}", n)), "")
    return keys.select(
        "l_orderkey",
        F.lit(f"{OWNER}/code").alias("namespace"),
        F.concat(F.lit(f"{OWNER}/code/p"), order.cast("string"), of(0)).alias("file_path"),
        put(F.concat(of(1), members, of(3)), "{k}", order).alias("content"),
    )


def notebooks_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook form of the code: a code cell per line of it, markdown between, both shapes of ``source``."""
    files = code_v(spark, sf_dir)
    lines = F.filter(F.split("content", "\n"), lambda l: l != "")

    def cells(line: Column, i: Column) -> Column:
        as_json = F.to_json(
            F.struct(F.lit("code").alias("cell_type"), line.alias("source"))
        )
        as_list = F.to_json(
            F.struct(F.lit("code").alias("cell_type"), F.array(line).alias("source"))
        )
        note = F.lit('{"cell_type":"markdown","source":"a note"}')
        return F.concat_ws(",", F.when(i % 2 == 0, as_json).otherwise(as_list), note)

    return files.select(
        "l_orderkey",
        "namespace",
        F.replace("file_path", F.lit(".py"), F.lit(".ipynb")).alias("file_path"),
        F.concat(F.lit('{"cells":['), F.concat_ws(",", F.transform(lines, cells)), F.lit("]}")).alias("content"),
    )


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """The files written as files of a tree in the shared folder, which has to be a mounted one; its path."""
    root = scratch_path(spark, "tree").removeprefix("file://").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: those of a batch may be large together.
            for path, content in zip(batch.column(0), batch.column(1)):
                target = os.path.join(root, path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write((content.as_py() or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files_v(spark, sf_dir).select("file_path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


def qrels_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain which benchmark passage, as ``(query_id, doc_id, relevance)``."""
    return passage_matches(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")),
    ).withColumn("relevance", F.lit(1))


def jobs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "view"), "completed")
        .when(kind == "error", "failed")
        .when(kind == "click", "in_progress")
        .otherwise("validating")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("dataset"),
        status.alias("status"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("file-"), F.col("event_id").cast("string"))).alias(
            "output_file_id"
        ),
    )


def path_questions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per namespace and folder that holds files."""
    parts = F.split("file_path", "/")
    folder = F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 4), " ")
    return (
        files_v(spark, sf_dir)
        .select("namespace", folder.alias("folder"))
        .distinct()
        .select(
            "namespace",
            F.concat_ws(" ", F.split_part("namespace", F.lit("/"), F.lit(2)), "folder").alias("query_id"),
            F.concat(F.lit("which "), F.col("folder"), F.lit(" files and tests exist")).alias("question"),
        )
    )
