"""Secret scan with linking of credentials that come in parts, in DataFrame functions only.

Three patterns are certain and always reported. Beyond them there are weak parts: account
identifiers, random-looking strings and endpoints, which mean little by themselves. A weak string is
reported only when an identifier or an endpoint stands within ``SCOPE`` characters of it, and these
parts are reported with it. Parts meet in an interval join: each text is divided into blocks of
``SCOPE`` characters, parts are filed where they start and where they end, and strings look into
the blocks of their ends and the ones beside them.

Positions are code points. They are found from the pieces that a pattern cuts a text into, as
lengths of gaps and matches add up to where a match starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Kind, pattern, and the least length: of the match, or of the group named beside it.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run that is long enough is found by the least length alone: within a shorter run nothing longer begins.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ["assign", "access", "hex"]

IDENTIFIER = r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}"""
#: Runs of base 64 characters; weak strings are those of forty, and hexadecimal ones too short to be certain.
RUN = r"[A-Za-z0-9+/]{16,}"
WEAK_LENGTH, WEAK_HEX = 40, 23
#: Runs of the characters of keys, the url-safe ones included, with their padding. Weak strings are also
#: those, at any length, that mix classes: digits with letters, or a capital directly behind a small letter;
#: and those of one class with at least ``ENTROPY`` bits a character.
KEY = r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ENTROPY = 3.5
KINDS = [*BASE, "weak", "identifier", "endpoint"]

#: Characters between a weak string and the parts that it is linked with.
SCOPE = 200
_STEP = 256
_NO_SPANS = "cast(array() as array<struct<start:int,end:int,kind:int>>)"


def starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts, given the pieces of text between matches.

    Running sums in runs of ``_STEP``, as a single fold would copy its result at every match.
    """
    step = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _STEP).cast("int")), lambda r: F.slice(step, r * _STEP + 1, _STEP))
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    sums = F.transform(runs, total)
    return F.flatten(
        F.transform(runs, lambda run, r: F.transform(run, lambda _, i: total(F.slice(sums, 1, r)) + total(F.slice(run, 1, i + 1))))
    )


def _found(df: DataFrame, name: str, pattern: str, kind: int, here: Column, group: int | None = None, least: int = 0) -> DataFrame:
    """Adds the column ``name`` with the spans of a pattern in ``_text``; ``here`` is false where it cannot occur."""
    has = here & F.col("_text").rlike(pattern)
    df = df.withColumns(
        {
            "_matches": F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))),
            "_groups": F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))) if group else F.lit(None).cast("array<string>"),
            "_gaps": F.when(has, F.split("_text", pattern, -1)),
        }
    )
    df = df.withColumn("_starts", F.when(F.size("_matches") > 0, starts(F.col("_gaps"), F.col("_matches"))))
    span = F.transform(
        F.col("_starts"),
        lambda s, i: F.struct(s.alias("start"), (s + F.length(F.get("_matches", i))).alias("end"), F.lit(kind).alias("kind")),
    )
    if group:
        span = F.filter(span, lambda _, i: F.length(F.get("_groups", i)) >= least)
    return df.withColumn(name, F.coalesce(span, F.expr(_NO_SPANS))).drop("_matches", "_groups", "_gaps", "_starts")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_key"), text.alias("_text"))


def certain(docs: DataFrame) -> DataFrame:
    """``(doc_id, _key, _assign, _access, _hex)``: the spans of the three certain patterns in every row."""
    df = _texts(docs)
    df = _found(df, "_assign", ASSIGN, 0, F.lit(True), 1, ASSIGN_LEAST)
    df = _found(df, "_access", ACCESS, 1, F.contains("_text", F.lit("AKIA")))
    return _found(df, "_hex", HEX, 2, F.lit(True)).drop("_text")


def entropy(text: Column) -> Column:
    """Bits a character by how often each character occurs in a text that is not empty."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    return F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n


def _short(run: Column) -> Column:
    """Weak by its length: forty characters, or hexadecimal and too short to be certain."""
    return (F.length(run) == WEAK_LENGTH) | (F.length(run) <= WEAK_HEX) & ~run.rlike("[^0-9a-f]")


def _key(run: Column) -> Column:
    """Weak by its characters. What :func:`_short` has or a certain pattern reports whole is not found again."""
    core = F.rtrim(run, F.lit("="))
    plain = (F.length(core) == WEAK_LENGTH) & ~core.rlike("[_-]") | (F.length(core) <= WEAK_HEX) & ~core.rlike("[^0-9a-f]")
    whole = core.rlike(f"^(?:{HEX}|{ACCESS})$")
    mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]") | core.rlike("[a-z][A-Z]")
    return F.when(plain | whole, False).when(mixed, True).otherwise(entropy(core) >= ENTROPY)


def linked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, _key, _linked)`` of the rows in which weak strings stand near complementary parts, with the spans of both.

    Within a text at most ``scope`` parts of a kind begin in one block and as many end in it, so no group is large.
    """
    text = F.col("_text")
    # Without a part there is nothing to link, which costs less to find out.
    parted = F.contains("_text", F.lit("://")) | F.contains("_text", F.lit("AKIA")) | text.rlike(IDENTIFIER)
    df = _texts(docs).where(F.when(parted, text.rlike(KEY)).otherwise(False)).distinct()
    own = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    df = _found(df, "_short", RUN, 3, F.lit(True)).withColumn("_short", F.filter("_short", lambda s: _short(own(s))))
    df = _found(df, "_long", KEY, 3, F.lit(True)).withColumn("_long", F.filter("_long", lambda s: _key(own(s))))
    df = df.withColumn("_weak", F.concat("_short", "_long")).drop("_short", "_long").where(F.size("_weak") > 0)
    df = _found(df, "_identifier", IDENTIFIER, 4, F.lit(True))
    df = _found(df, "_access", ACCESS, 4, F.contains("_text", F.lit("AKIA")))
    df = _found(df, "_endpoint", ENDPOINT, 5, F.contains("_text", F.lit("://")))
    parts = stored(df.drop("_text"), "parts")
    block = lambda at: F.floor(at / scope).cast("int")
    # A part before a string ends in the block where the string begins or the one before; a part behind it
    # begins in the block where the string ends or the next one.
    first, last = block(F.col("w.start")), block(F.col("w.end"))
    weak = parts.select("doc_id", "_key", F.explode_outer("_weak").alias("w")).select(
        "doc_id", "_key", F.col("w"), F.explode(F.array_distinct(F.array(first - 1, first, last, last + 1))).alias("block")
    )
    ends = F.array_distinct(F.array(block(F.col("p.start")), block(F.col("p.end"))))
    near = parts.select("doc_id", "_key", F.explode_outer(F.concat("_identifier", "_access", "_endpoint")).alias("p")).select(
        F.col("doc_id").alias("_doc"), F.col("_key").alias("_other"), "p", F.explode(ends).alias("_block")
    )
    # The part that starts within the scope behind a string, or before it and ends within the scope.
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_other")) & (F.col("block") == F.col("_block"))
    gap = F.greatest(F.col("p.start") - F.col("w.end"), F.col("w.start") - F.col("p.end"))
    apart = (F.col("p.start") >= F.col("w.end")) | (F.col("p.end") <= F.col("w.start"))
    met = weak.join(near, same & apart & (gap <= scope))
    spans = F.explode(F.array("w", "p")).alias("span")
    return met.select("doc_id", "_key", spans).groupBy("doc_id", "_key").agg(F.collect_set("span").alias("_linked"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, linked)`` for every row of ``docs(doc_id, text, …)``.

    ``base`` has the spans of the certain patterns, ``linked`` those of weak strings and of the
    identifiers and endpoints they are linked with, both as ``(start, end, kind)`` with the number of the kind in ``KINDS``.

    * Null counts as empty; empty texts have no spans. Matches of a kind do not overlap; spans of different
      kinds may, and a weak string of forty characters may lie in a longer one.
    * Repeated rows give repeated result rows; a row without ``doc_id`` is scanned like others.
    * An empty table gives an empty result; other columns are ignored whatever their names.
    """
    base = certain(docs)
    parts = linked(docs, scope).select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_other"), "_linked")
    joined = base.join(parts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_other")), "left")
    return joined.select(
        "doc_id",
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE],
        F.concat("_assign", "_access", "_hex").alias("base"),
        # An identifier may be one that the certain patterns have as well; those stay as they are.
        F.coalesce("_linked", F.expr(_NO_SPANS)).alias("linked"),
    )


def digests(found: DataFrame) -> DataFrame:
    """The result of :func:`find_secrets` with its spans as text: ``base_sha256`` and ``spans``, by start, then kind."""
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans")
    )
