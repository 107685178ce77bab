"""Jobs made of the operators: building an index from files and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_url
from ..operators import chunking, embedding, filters, issues as issue_ops
from ..operators.index import Index, union_sources
from ..session import stored


def index_rows(
    files: DataFrame | None,
    issues: DataFrame | None,
    max_tokens: int,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    embedder: embedding.Embedder | None = None,
    **embedder_options,
) -> DataFrame:
    """Filter, chunk and embed; every step up to the write is narrow."""
    parts = []
    if files is not None:
        kept = filters.apply_rules(files, include, exclude)
        parts.append(chunking.chunk_any(kept, max_tokens))
    if issues is not None:
        parts.append(issue_ops.chunk_issue(issues, max_tokens))
    if not parts:
        raise ValueError("nothing to index: give files, issues or both")
    chunks = parts[0] if len(parts) == 1 else union_sources(*parts)
    return embedding.embed_chunks(chunks, embedder, **embedder_options)


def build_index(index: Index, commit: int = 0, **sources) -> Index:
    """Scan results to a committed index. Chunks whose embedding failed are not indexed but
    kept as Parquet next to the index, in ``<index>.errors``."""
    rows = index_rows(**sources)
    if "error" in rows.columns:
        rows, errors = embedding.split_errors(stored(rows, "embedded"))
        errors.write.mode("overwrite").parquet(f"{index.path}.errors/commit={commit}")
    # Chunk ids follow from path and offsets, so one scan gives each id once.
    index.upsert(rows, commit, unique=True)
    return index


def with_urls(files: DataFrame) -> DataFrame:
    return files.withColumn("url", file_url(F.col("file_path"), F.col("namespace")))
