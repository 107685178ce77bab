"""Path rules: hidden files, inclusion and exclusion by extension, name or directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Up to this many rules become literals of one narrow filter; more are joined.
LITERAL_RULES = 10_000
KINDS = ("ext", "file", "dir")


def filter_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~paths.is_hidden(F.col("file_path")))


def path_parts(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return files.withColumns(
        {
            "ext": paths.extension(path),
            "file_name": paths.file_name(path),
            "dirs": paths.directories(path),
        }
    )


def _normal(kind: Column, value: Column) -> Column:
    return F.when(kind == "ext", F.lower(value)).otherwise(value)


def _literal_match(rules: list, path: Column) -> Column:
    values = {kind: [r["value"] for r in rules if r["kind"] == kind] for kind in KINDS}
    return (
        paths.extension(path).isin(values["ext"])
        | paths.file_name(path).isin(values["file"])
        | F.arrays_overlap(
            paths.directories(path), F.array(*[F.lit(v) for v in values["dir"]]).cast("array<string>")
        )
    )


def _few(rules: DataFrame) -> tuple[DataFrame, list | None]:
    """Normalised rules, and their rows when they are few enough to become literals."""
    rules = rules.select("kind", _normal(F.col("kind"), F.col("value")).alias("value")).distinct()
    rows = rules.limit(LITERAL_RULES + 1).collect()
    return rules, rows if len(rows) <= LITERAL_RULES else None


def _paths_that_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct paths with a rule, by a join."""
    path = F.col("file_path")
    keys = files.select(
        "file_path",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("ext").alias("kind"), paths.extension(path).alias("value")),
                    F.struct(F.lit("file").alias("kind"), paths.file_name(path).alias("value")),
                ),
                F.transform(
                    paths.directories(path), lambda d: F.struct(F.lit("dir").alias("kind"), d.alias("value"))
                ),
            )
        ).alias("k"),
    ).select("file_path", "k.*")
    return keys.join(rules, ["kind", "value"], "left_semi").select("file_path").distinct()


def _matching(files: DataFrame, rules: DataFrame, keep_matches: bool) -> DataFrame:
    rules, rows = _few(rules)
    if rows is not None:
        matched = _literal_match(rows, F.col("file_path"))
        return files.filter(matched if keep_matches else ~matched)
    how = "left_semi" if keep_matches else "left_anti"
    return files.join(_paths_that_match(files, rules), "file_path", how)


def filter_include(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep files whose extension, name or any directory is in the rules."""
    return _matching(files, rules, keep_matches=True)


def filter_exclude(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop files whose extension, name or any directory is in the rules."""
    return _matching(files, rules, keep_matches=False)


def apply_rules(
    files: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """The whole path filter: hidden files go first, then at most one rule set."""
    if include is not None and exclude is not None:
        raise ValueError("give either inclusion or exclusion rules, not both")
    visible = filter_hidden(files)
    if include is not None:
        return filter_include(visible, include)
    if exclude is not None:
        return filter_exclude(visible, exclude)
    return visible


def excluded_paths(files: DataFrame, included: DataFrame) -> DataFrame:
    return files.select("file_path").subtract(included.select("file_path"))


def filter_audit(
    files: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """Every path with the flag whether the rules keep it; a narrow projection for few rules."""
    if include is not None and exclude is not None:
        raise ValueError("give either inclusion or exclusion rules, not both")
    kept = ~paths.is_hidden(F.col("file_path"))
    rules = include if include is not None else exclude
    if rules is None:
        return files.select("namespace", "file_path", kept.alias("included"))
    rules, rows = _few(rules)
    if rows is not None:
        matched = _literal_match(rows, F.col("file_path"))
    else:
        hits = _paths_that_match(files, rules).withColumn("_hit", F.lit(True))
        files = files.join(hits, "file_path", "left")
        matched = F.coalesce("_hit", F.lit(False))
    return files.select(
        "namespace", "file_path", (kept & (matched if include is not None else ~matched)).alias("included")
    )


def write_audit(audit: DataFrame, path: str) -> None:
    """Included and excluded path lists per namespace, as folders."""
    audit.write.mode("overwrite").partitionBy("namespace", "included").text(path)
