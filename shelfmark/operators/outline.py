"""Indented outlines of namespaces: folders, files, classes and public methods.

The outline is a frame of lines. Text is assembled only for outlines that were cut to a
token limit, so no row grows with its namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors, path_order
from ..functions.rows import explode_computed
from ..functions.tokens import count_tokens, truncate_tokens
from ..session import fits, stored

INDENT = 4
TOKEN_LIMIT = 150_000
SMALL_CORPUS_FILES = 200
#: Parts of a namespace whose first lines are found apart from each other.
PARTS = 16
#: Variants from the richest to the leanest: (name, with classes, with methods).
VARIANTS = (("methods", True, True), ("classes", True, False), ("files", False, False))


def symbol_nodes(symbols: DataFrame, classes: bool, methods: bool) -> DataFrame:
    """Nodes below the files ``(namespace, node_path, depth, name, need)``, not yet distinct.

    A method's class is part of its path, so it is a node wherever the method is. ``need`` is
    1 for a class listed for itself and 0 for what only the methods ask for.
    """
    path, cls, fun, depth = F.col("file_path"), F.col("class_name"), F.col("method_name"), F.col("_depth")
    public = fun.isNotNull() & ~fun.startswith("_") & F.lit(methods)
    listed = fun.isNull() & F.lit(classes)

    def node(when: Column, node_path: Column, at: Column, name: Column, need: Column) -> Column:
        return F.when(
            when,
            F.struct(node_path.alias("node_path"), at.alias("depth"), name.alias("name"), need.alias("need")),
        )

    # A null is no node, and is left out where the array becomes rows.
    nodes = F.array(
        node(cls.isNotNull() & (listed | public), F.concat_ws("/", path, cls), depth, cls, fun.isNull().cast("int")),
        node(public, F.concat_ws("/", path, cls, fun), F.when(cls.isNull(), depth).otherwise(depth + 1), fun, F.lit(0)),
    )
    deep = symbols.withColumn("_depth", F.size(F.split(path, "/")))
    return explode_computed(deep, ["namespace"], nodes, "a").select("namespace", "a.*")


def path_ancestors(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """Distinct ``(namespace, node_path, depth, name)`` over all prefixes of the paths."""
    rows = explode_computed(paths, ["namespace"], ancestors(F.col(path)), "a")
    return rows.select("namespace", "a.*").distinct()


def _line(name: Column, depth: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), depth * INDENT), name)


def render_tree(
    files: DataFrame, symbols: DataFrame | None = None, classes: bool = True, methods: bool = True
) -> DataFrame:
    """Outline lines ``(namespace, node_path, depth, line)``; sort by ``path_order(node_path)``."""
    nodes = path_ancestors(files)
    if symbols is not None and (classes or methods):
        below = symbol_nodes(symbols, classes, methods).drop("need").distinct()
        nodes = nodes.unionByName(below)
    return nodes.select("namespace", "node_path", "depth", _line(F.col("name"), F.col("depth")).alias("line"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Files, chunks and tokens per namespace, and whether it is small enough for symbols."""
    return chunks.groupBy("namespace").agg(
        F.countDistinct("file_path").alias("n_files"),
        F.count("*").alias("n_chunks"),
        F.sum("num_tokens").alias("n_tokens"),
    ).withColumn("is_small", F.col("n_files") <= SMALL_CORPUS_FILES)


def _leveled_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All lines with the leanest variant that shows them: 2 files, 1 classes, 0 methods."""
    nodes = path_ancestors(files).withColumn("need", F.lit(2))
    below = symbol_nodes(symbols, True, True).groupBy("namespace", "node_path", "depth", "name").agg(
        F.max("need").alias("need")
    )
    # The indentation has no tokens; without a depth there is no line.
    shown = F.when(F.col("depth").isNotNull(), F.col("name"))
    return nodes.unionByName(below).select(
        "namespace", "node_path", "need", _line(F.col("name"), F.col("depth")).alias("line"), count_tokens(shown).alias("tokens")
    )


def fit_tree(files: DataFrame, symbols: DataFrame, max_tokens: int = TOKEN_LIMIT) -> DataFrame:
    """``(namespace, variant, n_tokens, outline)``: the richest outline within the limit.

    When even the file outline is too long it is cut after ``max_tokens`` tokens. Each task then keeps
    only as many first lines as can be needed, so the lines of a large namespace are never together in one task.
    """
    # Stored once: the sizes, the sampling for the sort and the sort itself all read it.
    lines = stored(_leveled_lines(files, symbols), "outline")
    # need: 2 = in all variants, 1 = from classes up, 0 = only with methods.
    sums = lines.groupBy("namespace").agg(
        *[
            F.sum(F.when(F.col("need") >= level, F.col("tokens")).otherwise(0)).alias(name)
            for level, (name, _, _) in enumerate(VARIANTS)
        ],
        F.count_if(F.col("tokens") == 0).alias("bare"),
    )
    level = F.lit(len(VARIANTS) - 1)
    variant = F.lit("truncated")
    for i, (name, _, _) in reversed(list(enumerate(VARIANTS))):
        level = F.when(F.col(name) <= max_tokens, i).otherwise(level)
        variant = F.when(F.col(name) <= max_tokens, F.lit(name)).otherwise(variant)
    choice = stored(sums.select("namespace", level.alias("level"), variant.alias("variant"), "bare"), "variants")
    bare = choice.agg(F.max("bare")).first()[0] or 0
    choice = choice.drop("bare")
    # A row per namespace; sent to the lines, as those of a large namespace would meet in one task.
    choice = F.broadcast(choice) if fits(choice) else choice
    chosen = lines.join(choice, "namespace").filter(F.col("need") >= F.col("level"))
    # Only outlines that are too long need to be in order before they are put together.
    fitting = chosen.filter("variant <> 'truncated'")
    kept = fitting.unionByName(_first_tokens(chosen.filter("variant = 'truncated'"), max_tokens, bare))
    ordered = F.array_sort(F.collect_list(F.struct(path_order(F.col("node_path")).alias("o"), "line")))
    return kept.groupBy("namespace", "variant").agg(
        F.sum("tokens").alias("n_tokens"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("outline"),
    )


def _first_tokens(lines: DataFrame, max_tokens: int, bare: int) -> DataFrame:
    """Lines, in path order, up to ``max_tokens`` tokens per namespace; the last line may be cut.

    A line has a token at least, but for at most ``bare`` lines of a namespace, so no more lines than both
    together can be among the first. So many are kept by each task, by each part of a namespace, and then of
    the namespace; what is added up is never longer than that.
    """
    most = max_tokens + bare
    ordered = lines.withColumns({"_o": path_order(F.col("node_path")), "_part": F.pmod(F.xxhash64("node_path"), F.lit(PARTS))})
    for by in (["namespace", "_part"], ["namespace"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_o"))
        ordered = ordered.withColumn("_n", place).filter(F.col("_n") <= most)
    before = Window.partitionBy("namespace").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(max_tokens) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return (
        ordered.withColumn("_room", room)
        .filter("_room > 0")
        .withColumn(
            "line",
            F.when(F.col("tokens") > F.col("_room"), truncate_tokens(F.col("line"), F.col("_room").cast("int"))).otherwise(F.col("line")),
        )
        .withColumn("tokens", F.least("tokens", "_room"))
        .drop("_o", "_n", "_part", "_room")
    )
