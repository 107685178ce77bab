"""Tokenizer expressions. All of them are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token is a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM = r"[\p{L}\p{N}_]+"
#: White space plus the token behind it; the matches of a text rejoin to exactly that text.
PIECE = rf"\s*(?:{TOKEN})|\s+\z"
WHITESPACE = " \t\n\r\f\x0b"


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def terms(text: Column) -> Column:
    """Lower-cased words in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def truncate_tokens(text: Column, n: Column | int) -> Column:
    """The text up to the end of its n-th token."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(pieces(text), F.lit(1), F.greatest(n, F.lit(0))), "")


def term_counts(term_array: Column) -> Column:
    """``array<struct<term, tf>>`` of a term array, by run lengths over the sorted array.

    Stays inside the row, so counting the terms of a document needs no shuffle.
    """
    run_starts = lambda s: F.filter(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
    )

    def runs(both: Column) -> Column:
        return F.transform(
            both["at"],
            lambda p, j: F.struct(
                F.get(both["s"], p).alias("term"),
                (F.coalesce(F.get(both["at"], j + 1), F.size(both["s"])) - p).alias("tf"),
            ),
        )

    # The one-element arrays bind an intermediate result to a lambda variable, so that
    # it is computed once per row.
    bound = F.transform(
        F.array(F.sort_array(term_array)),
        lambda s: F.struct(s.alias("s"), run_starts(s).alias("at")),
    )
    counted = F.get(F.transform(bound, runs), F.lit(0))
    return F.when(F.size(term_array) > 0, counted)


def path_terms(path: Column) -> Column:
    """Words of a path or symbol: cut at non-word characters, underscores and case changes."""
    spaced = F.regexp_replace(path, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
