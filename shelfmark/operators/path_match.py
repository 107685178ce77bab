"""Guessed paths against the paths of a corpus: exact, repaired, or nearest by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import fix_path
from ..functions.rows import explode_computed
from ..session import BROADCAST_ROWS, cut_lineage

MAX_EDIT_DISTANCE = 10
#: Distances of the search rounds. A guess leaves the search with the first round that finds a path for it.
ROUNDS = (2, 5, 10)


def _bare(path: Column, kind: Column) -> Column:
    """A path without the namespace it begins with (kind 1), which changes no distance to another one like it."""
    return F.when(kind == 1, F.substring(path, F.length("namespace") + 2, F.length(path))).otherwise(path)


def _pieces(s: Column, distance: int) -> Column:
    """Twice as many pieces as ``distance + 1``, as far as the string has characters: ``array<struct<piece, pos>>``."""
    n = F.length(s)
    count = F.least(n, F.lit(2 * distance + 2))
    at = lambda i: F.floor(i * n / count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.substring(s, at(i) + 1, at(i + 1) - at(i)).alias("piece"), at(i).alias("pos"))
    )


def _index(paths: DataFrame, distance: int) -> DataFrame:
    """``(namespace, kind, key, pos, file_path, s)``: the ``distance + 1`` rarest pieces of each path, with their places.

    A string within the distance changes at most ``distance`` pieces, so it has at least one of these unchanged,
    whichever they are. Paths with fewer characters than that are known by their length.
    """
    keys = ["namespace", "kind", "file_path", "s"]
    long = paths.filter(F.length("s") > distance)
    rows = long.select(*keys, F.explode(_pieces(F.col("s"), distance)).alias("p")).select(*keys, "p.piece", "p.pos")
    counted = rows.groupBy("namespace", "kind", "piece").agg(F.count("*").alias("n"))
    chosen = rows.join(counted, ["namespace", "kind", "piece"]).groupBy(*keys).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "pos", "piece"))), 1, distance + 1).alias("p")
    )
    rare = chosen.select(*keys, F.explode("p").alias("p")).select(*keys, F.concat(F.lit("p"), "p.piece").alias("key"), "p.pos")
    short = paths.filter(F.length("s") <= distance)
    return rare.unionByName(short.select(*keys, F.concat(F.lit("n"), F.length("s").cast("string")).alias("key"), F.lit(0).alias("pos")))


def _looked_up(guesses: DataFrame, distance: int) -> DataFrame:
    """``(namespace, kind, guess, g, key, pos)``: all substrings that may be a piece of a path within the distance."""
    n = F.length("g")
    pieces = 2 * distance + 2
    low = F.greatest(F.floor((n - distance) / pieces).cast("int"), F.lit(1))
    high = F.greatest(F.ceil((n + distance) / pieces).cast("int"), low)
    of_length = lambda size: F.transform(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.struct(F.concat(F.lit("p"), F.substring("g", i + 1, size)).alias("key"), i.alias("pos"))
    )
    parts = F.flatten(F.transform(F.sequence(low, high), of_length))
    lengths = F.transform(
        F.sequence(F.greatest(n - distance, F.lit(0)), F.least(n + distance, F.lit(distance))),
        lambda m: F.struct(F.concat(F.lit("n"), m.cast("string")).alias("key"), F.lit(0).alias("pos")),
    )
    both = F.concat(parts, F.when(n <= 2 * distance, lengths).otherwise(F.filter(lengths, lambda _: F.lit(False))))
    return explode_computed(guesses, ["namespace", "kind", "guess", "g"], both, "k").select("namespace", "kind", "guess", "g", "k.key", "k.pos")


def _round(guesses: DataFrame, paths: DataFrame, distance: int) -> DataFrame:
    """Nearest path within ``distance`` of every guess that has one."""
    wanted = guesses.select("namespace", "kind").distinct()
    begins = F.startswith("file_path", F.concat("namespace", F.lit("/")))
    corpus = paths.join(wanted, "namespace").filter((F.col("kind") == 0) | begins)
    # Guesses of kind 1 meet paths of kind 1; a path of another form is no nearer than its form.
    index = _index(corpus.withColumn("s", _bare(F.col("file_path"), F.col("kind"))), distance)
    near = (F.abs(F.length("g") - F.length("s")) <= distance) & (F.abs(F.col("pos") - F.col("at")) <= distance)
    close = (
        _looked_up(guesses, distance)
        .join(index.withColumnRenamed("pos", "at"), ["namespace", "kind", "key"])
        .filter(near)
        .withColumn("distance", F.levenshtein("g", "s", distance))
        .filter("distance >= 0")
    )
    best = close.groupBy("namespace", "guess").agg(F.min(F.struct("distance", "file_path")).alias("b"))
    return best.select("namespace", "guess", "b.file_path", "b.distance")


def nearest_path(guesses: DataFrame, paths: DataFrame, max_distance: int = MAX_EDIT_DISTANCE) -> DataFrame:
    """``(namespace, guess, file_path, distance)``; guesses without a path within reach are left out.

    Ties go to the smallest path. ``guesses`` is ``(namespace, guess)``, ``paths`` is
    ``(namespace, file_path)``; a guess is compared with paths of its namespace only.
    """
    paths = paths.select("namespace", "file_path").distinct()
    wanted = guesses.select("namespace", "guess").distinct()
    exact = wanted.join(
        paths.withColumn("guess", F.col("file_path")), ["namespace", "guess"]
    ).select("namespace", "guess", "file_path", F.lit(0).alias("distance"))
    # Where all paths of a namespace begin with it, guesses that do so too are compared without it.
    foreign = paths.filter(~F.startswith("file_path", F.concat("namespace", F.lit("/")))).select("namespace", F.lit(True).alias("_foreign")).distinct()
    kind = F.when(F.startswith("guess", F.concat("namespace", F.lit("/"))) & F.col("_foreign").isNull(), 1).otherwise(0)
    open_ = wanted.join(exact, ["namespace", "guess"], "left_anti").join(foreign, "namespace", "left")
    found = exact
    left = cut_lineage(open_.select("namespace", "guess", kind.alias("kind")).withColumn("g", _bare(F.col("guess"), F.col("kind"))))
    for distance in [d for d in ROUNDS if d < max_distance] + [max_distance]:
        if max_distance < 1 or left.isEmpty():
            break
        # Only namespaces that still have open guesses are cut into pieces.
        hit = cut_lineage(_round(left, paths, distance))
        found = found.unionByName(hit)
        left = cut_lineage(left.join(hit, ["namespace", "guess"], "left_anti"))
    return found


def validate_paths(
    guesses: DataFrame, paths: DataFrame, k: int | None = None, max_distance: int = MAX_EDIT_DISTANCE
) -> DataFrame:
    """Guessed paths turned into paths of the corpus: ``(query_id, namespace, file_path, rank)``.

    ``guesses`` is ``(query_id, namespace, position, guess)``. A guess that is no path of the
    corpus and has no slash is dropped; others are repaired, then replaced by the nearest
    path. Each path counts once per query, at its first position, and k are kept.
    """
    known = paths.select("namespace", "file_path").distinct()
    exact = guesses.join(known.withColumn("guess", F.col("file_path")), ["namespace", "guess"])
    rest = guesses.join(known.withColumnRenamed("file_path", "guess"), ["namespace", "guess"], "left_anti")
    repaired = rest.filter(F.col("guess").contains("/")).withColumn(
        "guess", fix_path(F.col("guess"), F.col("namespace"))
    )
    matched = repaired.join(nearest_path(repaired, known, max_distance).drop("distance"), ["namespace", "guess"])
    columns = ["query_id", "namespace", "position", "file_path"]
    once = (
        exact.select(*columns)
        .unionByName(matched.select(*columns))
        .groupBy("query_id", "namespace", "file_path")
        .agg(F.min("position").alias("position"))
    )
    ranked = once.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "file_path"))
    )
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).drop("position")


def hydrate_files(chosen: DataFrame, files: DataFrame, at_most: int | None = None) -> DataFrame:
    """Full documents for chosen paths, by namespace too; either both sides have one or none has.

    ``at_most`` bounds the number of choices, if known.
    """
    if at_most is not None and at_most <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    if ("namespace" in chosen.columns) != ("namespace" in files.columns):
        raise ValueError("one side has a namespace and the other has none: a path alone may be in several")
    keys = [k for k in ("namespace", "file_path") if k in files.columns]
    return files.select(*keys, "content").join(chosen, keys)
