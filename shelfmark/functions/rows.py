"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, keep: list[str], array: Column | str, name: str) -> DataFrame:
    """One row per element of a computed array; rows with an empty array give none.

    A plain ``explode`` makes the optimizer add ``size(array) > 0`` and push it below the
    projection, which computes an expensive array twice. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
