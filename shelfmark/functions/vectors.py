"""Vector expressions and the offline default embedding."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import terms

DIMENSIONS = 64

# Vector sizes of known embedding models, and what unlisted ones of a family have.
MODEL_DIMENSIONS = {
    "text-embedding-ada-002": 1536,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-004": 768,
    "voyage-3-lite": 512,
    "voyage-2-code": 1536,
}
FAMILY_DIMENSIONS = {"voyage-": 1024}


def embedding_size(model: Column, default: int | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(MODEL_DIMENSIONS.items())])
    families = [F.when(model.startswith(prefix), size) for prefix, size in FAMILY_DIMENSIONS.items()]
    return F.coalesce(F.try_element_at(table, model), *families, F.lit(default).cast("int"))


def term_bucket(term: Column) -> Column:
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 4), 16, 10).cast("int") % DIMENSIONS).cast("int")


def hashed_counts(text: Column) -> Column:
    """Array of the number of terms of the text that fall in each bucket."""
    buckets = F.transform(terms(text), term_bucket)

    def histogram(b: Column) -> Column:
        return F.array(*[F.size(b) - F.size(F.array_remove(b, i)) for i in range(DIMENSIONS)])

    return F.get(F.transform(F.array(buckets), histogram), F.lit(0))


def l2_normalize(counts: Column) -> Column:
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    bound = F.transform(F.array(squares), lambda s: F.transform(counts, lambda c: F.when(s > 0, c / F.sqrt(s)).otherwise(0.0)))
    return F.get(bound, F.lit(0))


def hashed_embedding(text: Column) -> Column:
    """Unit vector of term counts in ``DIMENSIONS`` hash buckets; zeros for a text without terms."""
    return F.get(F.transform(F.array(hashed_counts(text)), l2_normalize), F.lit(0))
