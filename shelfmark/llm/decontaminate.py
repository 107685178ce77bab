"""Benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame functions only.

Every window of ``WINDOW`` words of the benchmark is known by the hash of one *seed*, a shorter run
of words inside it. Of each document only every seventh seed is looked up (with 13 words a window
and 7 words a seed): a window is so long that exactly one of its seeds starts at such a place. The
seeds are exploded out of the row, probe the broadcast table of benchmark seeds inside the same
stage, and what matches is verified, first by the hash of the whole window, then word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SMALL_ROWS, hinted, lowered

WINDOW = 13
SEED_WORDS = 7
#: A document is contaminated when at least one in so many of its words is hit.
HIT_SHARE = 20

#: What lies between words, in lower-cased text and in text as it is.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text: A-Z lower-cased, runs of digits, letters and all that is not ASCII."""
    return F.array_remove(F.split(lowered(text), GAP), "")


def _seed_words(length: int) -> int:
    return min(SEED_WORDS, length)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(gram, length, gram_hash, items)``: each distinct window of words and the items that hold it.

    An item of fewer words than ``window`` is one window; an item without words has none. ``items``
    has no nulls, so an item without id still marks words but is not listed.
    """
    own = benchmark.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_words"))
    own = own.where(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("_words") - length)
    gram = F.explode(F.transform(starts, lambda s: F.slice("_words", s + 1, length))).alias("gram")
    found = own.select("_item", gram).groupBy("gram").agg(F.collect_set("_item").alias("items"))
    return found.select("gram", F.size("gram").alias("length"), F.xxhash64("gram").alias("gram_hash"), "items")


def _seed_hash(words_column: str, place: Column, length: int) -> Column:
    """Hash of the seed at a place. Single elements are read, as a slice inside a lambda copies the whole array."""
    return F.xxhash64(*[F.get(words_column, place + i) for i in range(_seed_words(length))])


def _seeds(found: DataFrame, length: int) -> DataFrame:
    offsets = F.explode(F.sequence(F.lit(0), F.lit(length - _seed_words(length)))).alias("offset")
    rows = found.where(F.col("length") == length).select("gram", "length", "gram_hash", offsets)
    return rows.select("length", _seed_hash("gram", F.col("offset"), length).alias("seed"), "offset", "gram_hash")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text_key, spans, items)`` of the rows of ``docs`` that hold a window of the benchmark.

    ``spans`` is the set of ``(start, length)`` of the windows in words, ``items`` the set of item
    ids. Rows are told apart by ``doc_id`` and the hash of their text; equal rows share a result row.
    """
    found = stored(grams(benchmark, window), "grams")
    lengths = sorted(r["length"] for r in found.select("length").distinct().collect())  # at most ``window`` values
    own = docs.select(F.col("doc_id"), _text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("words"))
    # Places of all lengths in one array of numbers: place * (window + 1) + length.
    probes = F.concat(F.expr("cast(array() as array<int>)"), *[_probes(length, window) for length in lengths])
    # Outer, because for the plain form the optimizer adds a filter that computes the array once more.
    probed = own.select("doc_id", "text_key", "words", F.explode_outer(probes).alias("probe"))
    place, probe_length = F.floor(F.col("probe") / (window + 1)).cast("int"), F.col("probe") % (window + 1)
    placed = probed.select("doc_id", "text_key", "words", probe_length.alias("length"), place.alias("place"))
    seed = F.lit(None).cast("long")
    for length in lengths:
        seed = F.when(F.col("length") == length, _seed_hash("words", F.col("place"), length)).otherwise(seed)
    probed = placed.withColumn("seed", seed)
    seeds = None
    for length in lengths:
        rows = _seeds(found, length)
        seeds = rows if seeds is None else seeds.unionByName(rows)
    if seeds is None:
        seeds = found.selectExpr("length", "gram_hash as seed", "length as offset", "gram_hash")
    met = probed.join(hinted(seeds, "seeds", 10 * SMALL_ROWS), ["length", "seed"])
    start = F.col("place") - F.col("offset")
    inside = met.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("words")))
    whole = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length"))
    likely = inside.withColumn("gram", whole).where(F.xxhash64("gram") == F.col("gram_hash"))
    sure = likely.select("doc_id", "text_key", "start", "length", "gram_hash", "gram").join(
        hinted(found.select("gram_hash", "gram", "items"), "windows"), ["gram_hash", "gram"]
    )
    return sure.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def _probes(length: int, window: int) -> Column:
    """The places of a document whose seeds are looked up for windows of one length."""
    q, unit = _seed_words(length), window + 1
    last = (F.size("words") - q) * unit + length
    places = F.when(F.size("words") >= q, F.sequence(F.lit(length), last, F.lit((length - q + 1) * unit)))
    return F.coalesce(places, F.expr("cast(array() as array<int>)"))


def _hit_words(spans: Column) -> Column:
    covered = F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    return F.array_distinct(F.flatten(covered))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs(doc_id, text, …)``.

    A word inside any occurrence of a benchmark window is hit. ``contaminated``: some word is hit,
    and at least one in ``HIT_SHARE``.

    * Null and empty texts and texts without words have no words and no hits; without hits
      ``items_sha256`` is the hash of the empty string.
    * Repeated rows give repeated result rows; rows without ``doc_id`` are judged like others.
    * An empty benchmark hits nothing; other columns are ignored whatever their names.
    """
    counted = docs.select(
        "doc_id",
        _text_key(F.col("text")).alias("text_key"),
        F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), ANY_GAP), "")).cast("long").alias("n_words"),
    )
    found = hits(docs, benchmark, window).select(
        F.col("doc_id").alias("_doc"),
        F.col("text_key").alias("_key"),
        F.size(_hit_words(F.col("spans"))).cast("long").alias("_hit"),
        F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("_items"),
    )
    same = counted["doc_id"].eqNullSafe(found["_doc"]) & (counted["text_key"] == found["_key"])
    hit = F.coalesce("_hit", F.lit(0).cast("long"))
    items = F.coalesce("_items", F.expr("cast(array() as array<string>)"))
    return counted.join(found, same, "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, by the rule of :func:`contamination`; all other rows stay as they are."""
    found = hits(docs, benchmark, window)
    # Only rows with hits can be dropped, so only their words are counted.
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.size(_hit_words(F.col("spans"))).alias("_hit"))
    n_words = F.size(F.array_remove(F.split(F.coalesce(docs["text"], F.lit("")), ANY_GAP), ""))
    bad = hinted(bad, "hits")
    same = docs["doc_id"].eqNullSafe(bad["_doc"]) & (_text_key(docs["text"]) == bad["_key"])
    return docs.join(bad, same & (bad["_hit"] * HIT_SHARE >= n_words), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word cut out of ``text``; the characters between words stay. Rows without hits are unchanged."""
    found = hits(docs, benchmark, window).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), _hit_words(F.col("spans")).alias("_covered")
    )
    found = hinted(found, "hits")
    pieces = F.split("text", ANY_GAP)
    gaps = F.split("text", ANY_GAP.replace("[", "[^").removesuffix("+") + "+")
    # The first word is empty when the text begins with a gap; then the first gap is not.
    shift = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0)
    kept = F.transform(pieces, lambda w, i: F.when(F.array_contains(found["_covered"], i - shift), "").otherwise(w))
    woven = F.when(
        F.startswith("text", F.lit("")) & (shift == 1),
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i + 1), F.lit("")))),
    ).otherwise(F.transform(kept, lambda w, i: F.concat(w, F.coalesce(F.get(gaps, i + 1), F.lit("")))))
    text = F.when(found["_covered"].isNull(), F.col("text")).otherwise(F.array_join(woven, ""))
    same = docs["doc_id"].eqNullSafe(found["_doc"]) & (_text_key(docs["text"]) == found["_key"])
    joined = docs.join(found, same, "left")
    return joined.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
