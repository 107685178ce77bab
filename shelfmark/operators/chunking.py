"""Cutting files into token-bounded chunks.

A file is one row and stays one row until its chunks are exploded, so chunking adds no shuffle, whatever
the size of a namespace. Texts are split and counted by array expressions. Where the cuts are is found from the
counts alone, in running sums and in one pass with a stack over the indentations, and takes time in
proportion to the lines of a file.
Offsets are characters, 0-based and end-exclusive, relative to the whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.languages import route_chunker
from ..functions.rows import explode_computed
from ..functions.tokens import WHITESPACE, count_tokens, pieces

#: Tokens kept free when neighbours are merged, and allowed for a comment's surroundings.
MERGE_SLACK = 50
COMMENT_SLACK = 20


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit(text: Column, tok: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (count_tokens(text) if tok is None else tok).alias("tok"))


def lines_of(content: Column) -> Column:
    """Lines with their newline."""
    return F.split(content, r"(?<=\n)")


def _cut_by_tokens(text: Column, budget: Column) -> Column:
    def cut(p: Column) -> Column:
        last = F.ceil(F.size(p) / budget).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: _unit(F.array_join(F.slice(p, i * budget + 1, budget), "")),
        )

    return _bind(pieces(text), cut)


def fine_units(lines: Column, budget: Column) -> Column:
    """Lines ``(text, tok, ind)`` as units of the same shape: what is over the budget is cut after sentence
    ends, and what is still over it every ``budget`` tokens. Only the first unit of a line has its indentation,
    -1 stands for a blank line and -2 for a continuation."""

    def by_sentence(line: Column) -> Column:
        sentences = F.transform(F.split(line["text"], r"(?<=[.!?])(?=\s)"), lambda t: _unit(t))
        cut = F.flatten(
            F.transform(
                sentences,
                lambda s: F.when(s["tok"] <= budget, F.array(s)).otherwise(_cut_by_tokens(s["text"], budget)),
            )
        )
        indent = lambda i: F.when(i == 0, F.coalesce(line["ind"], F.lit(-1))).otherwise(-2)
        return F.transform(cut, lambda u, i: F.struct(u["text"].alias("text"), u["tok"].alias("tok"), indent(i).alias("ind")))

    whole = lambda x: F.array(F.struct(x["text"].alias("text"), x["tok"].alias("tok"), F.coalesce(x["ind"], F.lit(-1)).alias("ind")))
    return F.flatten(F.transform(lines, lambda x: F.when(x["tok"] <= budget, whole(x)).otherwise(by_sentence(x))))


def packed(tokens: np.ndarray, limit: int, first: int = 0) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of consecutive units with at most ``limit`` tokens each; a larger unit stays alone.

    Units without tokens are white space: they go with the run before them, and in front of the
    first run they are left out. Each end is found by a binary search in the running sums.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    at = int(np.searchsorted(total, 0, side="right")) - 1
    while at < len(tokens):
        end = int(np.searchsorted(total, max(total[at] + limit, total[at + 1]), side="right")) - 1
        yield first + at, first + end
        at = end


def outline(indent: np.ndarray) -> np.ndarray:
    """Where the block of each line ends: at the next line that is not deeper. One pass with a stack of open blocks.

    Blank lines (negative) are no blocks and end none; their own entry is the next line.
    """
    ends = np.arange(1, len(indent) + 1)
    open_: list[int] = []
    for i, depth in enumerate(indent.tolist()):
        if depth < 0:
            continue
        while open_ and indent[open_[-1]] >= depth:
            ends[open_.pop()] = i
        open_.append(i)
    ends[open_] = len(indent)
    return ends


def blocks(tokens: np.ndarray, indent: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of units: the outermost blocks within the limit, cut from the top down at any depth.

    A block that is too long gives its first line and then the blocks inside of it. ``indent`` is that of the
    line a unit begins, -1 for a blank line and -2 for the continuation of a line that was cut as text.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    n = len(tokens)
    if total[-1] <= limit:
        yield 0, n
        return
    lines = np.flatnonzero(indent > -2)
    bounds = np.concatenate([lines, [n]])
    ends = bounds[outline(indent[lines])]
    depth = indent[lines]
    k = 0
    if len(lines) and lines[0] > 0:
        yield 0, int(lines[0])
    while k < len(lines):
        a = int(lines[k])
        if depth[k] >= 0 and total[ends[k]] - total[a] <= limit:
            yield a, int(ends[k])
            k = int(np.searchsorted(lines, ends[k]))
            continue
        # The line with the blank ones behind it.
        k += 1
        while k < len(lines) and depth[k] < 0:
            k += 1
        b = int(bounds[k])
        if total[b] - total[a] <= limit:
            yield a, b
        else:
            yield from packed(tokens[a:b], limit, a)


def merged(runs: list[tuple[int, int]], tokens: np.ndarray, header: int, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbours put together while both, headers included, stay clear of the limit.

    Token counts add up across units, so the stricter first test implies that the merged
    text (one header only) is within the limit.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    low = high = -1
    for a, b in runs:
        own = total[b] - total[a]
        if low >= 0 and (own == 0 or 2 * header + total[high] - total[low] + own < limit - MERGE_SLACK):
            high = b
        elif own:
            if low >= 0:
                yield low, high
            low, high = a, b
    if low >= 0:
        yield low, high


_RUNS = "array<struct<first:int,n:int,start:int,tok:int>>"


def _runs(limit: int):
    """``(tokens, lengths, indents, header, chunker)`` of the units of files to the runs that are their chunks.

    Numbers only: texts stay where they are.
    """

    @F.pandas_udf(_RUNS)
    def cut(tokens: pd.Series, lengths: pd.Series, indents: pd.Series, header: pd.Series, chunker: pd.Series) -> pd.Series:
        out = []
        for tok, size, ind, h, kind in zip(tokens, lengths, indents, header, chunker):
            tok = np.asarray(tok if tok is not None else [], dtype=np.int64)
            whole = int(tok.sum())
            if kind != "text" and whole <= limit - h:  # one block, if there is anything in it
                out.append([{"first": 0, "n": len(tok), "start": 0, "tok": whole}] if whole else [])
                continue
            if kind == "text":
                runs = packed(tok, limit - h)
            else:
                runs = merged(list(blocks(tok, np.asarray(ind, dtype=np.int64), limit - h)), tok, h, limit) if len(tok) else []
            start = np.concatenate([[0], np.cumsum(np.asarray(size if size is not None else [], dtype=np.int64))])
            total = np.concatenate([[0], np.cumsum(tok)])
            out.append([{"first": a, "n": b - a, "start": int(start[a]), "tok": int(total[b] - total[a])} for a, b in runs])
        return pd.Series(out)

    return cut


def _emit(df: DataFrame, spans: str, keys: list[str]) -> DataFrame:
    """Explode spans into chunk rows, with surrounding white space trimmed off by moving the offsets."""
    ws = F.lit(WHITESPACE)
    rows = explode_computed(df, keys, spans, "s")
    rows = rows.select(*keys, "s.start", "s.tok", F.ltrim("s.text", ws).alias("t"), F.char_length("s.text").alias("n"))
    rows = rows.filter(F.char_length("t") > 0).select(
        *keys,
        (F.col("start") + F.col("n") - F.char_length("t")).alias("start_pos"),
        "tok",
        F.rtrim("t", ws).alias("body"),
    )
    path, start = F.col("file_path"), F.col("start_pos")
    end = start + F.char_length("body")
    return rows.select(
        *keys,
        start,
        end.alias("end_pos"),
        F.char_length("body").alias("length"),
        (F.col("tok") + count_tokens(path)).alias("num_tokens"),
        paths.chunk_id(path, start, end).alias("chunk_id"),
        F.concat_ws("\n\n", path, "body").alias("text"),
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("namespace", "file_path", "url") if c in df.columns]


def _budgeted(df: DataFrame, max_tokens: int) -> DataFrame:
    """Adds the header cost; paths that leave no room for text are an error, not a dropped file."""
    header = count_tokens(F.col("file_path"))
    checked = F.when(header < max_tokens, header).otherwise(
        F.raise_error(F.concat(F.lit("max_tokens leaves no room behind the path "), F.col("file_path"))).cast("int")
    )
    return df.withColumn("_h", checked)


def _indent_of(line: Column) -> Column:
    return F.when(
        F.char_length(F.ltrim(line, F.lit(WHITESPACE))) > 0,
        F.char_length(line) - F.char_length(F.ltrim(line, F.lit(" \t"))),
    )


_CELLS = "array<struct<cell_type:string,source:{0},input:{0}>>"
_NOTEBOOK = f"cells {_CELLS}, worksheets array<struct<cells:{_CELLS}>>"


def _cells(content: Column, source: str) -> Column:
    """The cells of a notebook, those of all worksheets in the older format; null where it is none."""
    book = F.from_json(content, _NOTEBOOK.format(source))
    return F.coalesce(book["cells"], F.flatten(F.transform(book["worksheets"], lambda w: F.coalesce(w["cells"], F.array()))))


def notebook_code(content: Column) -> Column:
    """The code cells of a notebook joined by newlines; the code may be a string or an array of lines.

    Null where the content is no notebook; see :func:`notebook_errors`.
    """
    cells = F.zip_with(
        _cells(content, "string"),
        _cells(content, "array<string>"),
        lambda t, l: F.struct(
            t["cell_type"].alias("kind"),
            F.coalesce(
                F.array_join(l["source"], ""), t["source"], F.array_join(l["input"], ""), t["input"], F.lit("")
            ).alias("code"),
        ),
    )
    code = F.filter(cells, lambda c: c["kind"] == "code")
    return F.array_join(F.transform(code, lambda c: c["code"]), "\n")


def notebook_errors(files: DataFrame) -> DataFrame:
    """``(namespace, file_path, error)`` of the notebooks that cannot be read, which the chunkers leave out."""
    keys = [c for c in ("namespace", "file_path") if c in files.columns]
    books = files.where(route_chunker(F.col("file_path")) == "notebook")
    reason = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").when(
        F.from_json("content", "cells string, worksheets string").isNull() | ~F.trim("content").startswith("{"), "no JSON object"
    )
    return books.where(_cells(F.col("content"), "string").isNull()).select(*keys, F.coalesce(reason, F.lit("no cells")).alias("error"))


def _chunk(files: DataFrame, max_tokens: int, route: Column) -> DataFrame:
    """All chunkers in one pass over the files: which one runs is a CASE inside the row."""
    keys = [*_keys(files), "chunker"]
    budget = F.lit(max_tokens) - F.col("_h")
    df = _budgeted(files, max_tokens).withColumn("chunker", route)
    content = F.when(F.col("chunker") == "notebook", notebook_code(F.col("content"))).otherwise(F.col("content"))
    lines = F.transform(lines_of(content), lambda l: F.struct(l.alias("text"), count_tokens(l).alias("tok"), _indent_of(l).alias("ind")))
    units = df.select(*keys, "_h", fine_units(lines, budget).alias("_u"))
    of = lambda field: F.transform("_u", lambda u: u[field])
    sizes = F.transform("_u", lambda u: F.char_length(u["text"]))
    runs = units.withColumn("_r", _runs(max_tokens)(of("tok"), sizes, of("ind"), F.col("_h"), F.col("chunker")))

    def span(r: Column) -> Column:
        text = F.array_join(F.transform(F.slice("_u", r["first"] + 1, r["n"]), lambda u: u["text"]), "")
        return F.struct(r["start"].alias("start"), text.alias("text"), r["tok"].alias("tok"))

    return _emit(runs.select(*keys, F.transform("_r", span).alias("_s")), "_s", keys)


def chunk_text(files: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of whole lines, sentences or token runs, each within ``max_tokens`` including the path."""
    return _chunk(files, max_tokens, F.lit("text"))


def chunk_code(files: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of syntactic blocks, small neighbours merged; blank files give none."""
    return _chunk(files, max_tokens, F.lit("code"))


def chunk_notebook(files: DataFrame, max_tokens: int) -> DataFrame:
    """The code cells of notebooks, chunked as code; paths stay those of the notebooks."""
    return _chunk(files, max_tokens, F.lit("notebook"))


def chunk_any(files: DataFrame, max_tokens: int) -> DataFrame:
    """Each file by the chunker its name asks for."""
    return _chunk(files, max_tokens, route_chunker(F.col("file_path")))


def _merges(limit: int):
    """The sorted token counts of a file's chunks, headers included, to the runs of them that are put together."""

    @F.pandas_udf("array<struct<first:int,last:int,tok:int>>")
    def runs(tokens: pd.Series, header: pd.Series) -> pd.Series:
        out = []
        for tok, h in zip(tokens, header):
            own = np.asarray(tok, dtype=np.int64) - h
            spans = merged([(i, i + 1) for i in range(len(own))], own, h, limit)
            out.append([{"first": a, "last": b - 1, "tok": int(own[a:b].sum() + h)} for a, b in spans])
        return pd.Series(out)

    return runs


def merge_small_chunks(chunks: DataFrame, max_tokens: int, files: DataFrame | None = None) -> DataFrame:
    """The merge on stored chunk rows ``(file_path, start_pos, end_pos, num_tokens)``, headers counted in.

    A merged chunk spans the gap between its parts; it has the id of its place, and its text when ``files`` with the
    content are given. Rows are grouped per file, the unit that one task handles anyway.
    """
    keys = _keys(chunks)
    row = F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.col("num_tokens").alias("t"))
    grouped = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_c")).withColumn("_h", count_tokens(F.col("file_path")))
    found = grouped.withColumn("_r", _merges(max_tokens)(F.transform("_c", lambda c: c["t"]), F.col("_h")))
    spans = F.transform(
        "_r", lambda r: F.struct(F.get("_c", r["first"])["s"].alias("s"), F.get("_c", r["last"])["e"].alias("e"), r["tok"].alias("t"))
    )
    path, start, end = F.col("file_path"), F.col("start_pos"), F.col("end_pos")
    rows = explode_computed(found, keys, spans, "c").select(
        *keys, F.col("c.s").alias("start_pos"), F.col("c.e").alias("end_pos"), F.col("c.t").alias("num_tokens")
    )
    rows = rows.withColumn("chunk_id", paths.chunk_id(path, start, end))
    if files is None:
        return rows
    by = [k for k in ("namespace", "file_path") if k in rows.columns and k in files.columns]
    joined = rows.join(files.select(*by, F.col("content").alias("_content")), by, "left")
    return joined.withColumn("text", paths.chunk_content(path, F.col("_content"), start, end)).drop("_content")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk: the same id at the same place of the same file in the same namespace.

    Issue chunks have no path and no offsets; their id tells them apart.
    """
    keys = ["namespace", "chunk_id", "file_path", "start_pos", "end_pos"]
    return chunks.dropDuplicates([k for k in keys if k in chunks.columns])


def drop_stored_text(chunks: DataFrame) -> DataFrame:
    """Null text where it can be rebuilt from file and offsets; issue chunks keep theirs."""
    rebuildable = F.col("file_path").isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    return chunks.withColumn("text", F.when(~rebuildable, F.col("text")))


def hydrate_text(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Rebuild the text of chunk rows that were stored without it.

    Files are told apart by namespace and path where both sides have a namespace. The offsets of
    a notebook's chunks count in its code, so that is what they are cut from.
    """
    keys = [k for k in ("namespace", "file_path") if k in chunks.columns and k in files.columns]
    chunker = F.col("chunker") if "chunker" in chunks.columns else route_chunker(F.col("file_path"))
    source = files.select(*keys, F.col("content").alias("_content"))
    content = F.when(chunker == "notebook", notebook_code(F.col("_content"))).otherwise(F.col("_content"))
    rebuilt = paths.chunk_content(F.col("file_path"), content, F.col("start_pos"), F.col("end_pos"))
    return (
        chunks.join(source, keys, "left")
        .withColumn("text", F.coalesce("text", rebuilt))
        .drop("_content")
    )
