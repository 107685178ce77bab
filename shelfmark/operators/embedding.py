"""Chunk text to vectors: the native default, or any model behind a narrow Python boundary."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import hashed_embedding
from .batching import next_cuts

ATTEMPTS = 6
#: Texts in, one vector per text out.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_chunks(
    chunks: DataFrame,
    embedder: Embedder | None = None,
    batch_size: int = 128,
    max_tokens: int | None = None,
    attempts: int = ATTEMPTS,
    first_pause: float = 1.0,
) -> DataFrame:
    """Adds ``embedding`` (and ``error`` when a model is called). No shuffle either way.

    A model is called with at most ``batch_size`` texts and ``max_tokens`` tokens (``num_tokens``) at a time, a
    longer text by itself. A call that keeps failing gives rows with a null vector and the error, so one
    bad batch does not end the job.
    """
    if embedder is None:
        return chunks.withColumn("embedding", hashed_embedding(F.col("text")).cast("array<float>"))
    schema = T.StructType(
        [
            *chunks.schema.fields,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def call(texts: list[str]) -> tuple[list, str | None]:
        pause = first_pause
        for attempt in range(attempts):
            try:
                return [list(map(float, v)) for v in embedder(texts)], None
            except Exception as e:  # noqa: BLE001 - any model error becomes a row
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 < attempts:
                    time.sleep(pause)
                    pause *= 2
        return [None] * len(texts), error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cost = frame["num_tokens"].fillna(0).to_numpy(dtype="int64") if max_tokens is not None else np.zeros(len(frame), dtype="int64")
            cuts = next_cuts(cost, batch_size, max_tokens or 0).tolist()
            at = 0
            while at < len(frame):
                begin, at = at, cuts[at]
                part = frame.iloc[begin:at].copy()
                vectors, error = call(part["text"].tolist())
                part["embedding"] = pd.Series(vectors, index=part.index, dtype=object)
                part["error"] = pd.Series([error] * len(part), index=part.index, dtype=object)
                yield part

    return chunks.mapInPandas(run, schema)


def split_errors(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors, and the error table.

    Both read ``embedded``: store it first, or the model is called twice.
    """
    return (
        embedded.filter(F.col("error").isNull()).drop("error"),
        embedded.filter(F.col("error").isNotNull()).drop("embedding"),
    )
