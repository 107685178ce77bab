"""URL filtering by rules, and by trust that spreads over the graph of hosts.

Hosts that rules allow are trusted seeds, hosts that rules block are blocked seeds. Trust is a
personalised PageRank from the trusted hosts along links; distrust is one from the blocked hosts
against the links, as who links to bad hosts is suspect. A host of which no rule speaks is blocked
when its distrust exceeds its trust. All seeds together hold a fixed mass, which is counted in whole units of a wide
decimal, and shares are rounded down: sums are exact in any order, cannot overflow, and lose less than
one unit per link. Rounds go on until no more mass moves than a stated part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import lowered

#: (verdict, host and path prefix)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: Percent of a host's mass that follows links in a round; the rest returns to the seeds.
DAMPING = 85
#: Rounds end when all hosts together change by at most one in so many units of the mass. As every round
#: moves at most DAMPING percent of what the one before moved, that takes 57 rounds at most.
SETTLED = 10**4
#: Units that all seeds hold together, and the type that counts them.
UNITS = 10**27
MASS = "decimal(38,0)"

LINK = r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>/?#]+)"""


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(rules: list[tuple[str, str]], host_column: Column, path_column: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, nulls when none does; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, prefix in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = prefix.partition("/")
        fits = ((host_column == name) | F.endswith(host_column, F.lit("." + name))) & F.startswith(path_column, F.lit(slash + rest))
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` of different hosts: pages of ``src`` hold a link to ``dst``, with its scheme or without."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    rows = pages.select(host(F.col("url")).alias("src"), F.explode_outer(found).alias("link"))
    target = host(F.concat(F.lit("x://"), F.substring_index("link", "//", -1)))
    return rows.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def spread(links: DataFrame, seeds: DataFrame, src: str, dst: str) -> DataFrame:
    """``(host, mass)`` of personalised PageRank from ``seeds(host)`` along ``src`` to ``dst``, in ``UNITS`` in all.

    A round joins the mass of a host with its links and sums by target, combined before the
    shuffle; each round is written to the shared folder. Mass at hosts without links is dropped. The
    mass at links is far above the number of hosts, so shares behind hubs do not round to nothing.
    """
    n = seeds.count()
    start = seeds.select("host", F.lit(str(UNITS // max(n, 1))).cast(MASS).alias("mass"))
    degree = links.groupBy(F.col(src).alias("from")).agg(F.count("*").alias("degree"))
    edges = stored(links.select(F.col(src).alias("from"), F.col(dst).alias("to")).join(degree, "from"), "links")
    if not n or edges.isEmpty():
        return start
    home = stored(seeds.select("host", F.lit(str((UNITS - UNITS * DAMPING // 100) // n)).cast(MASS).alias("mass")), "seeds")
    mass = start
    while True:
        each = edges.join(mass.withColumnRenamed("host", "from"), "from")
        # Division rounds to six places, by which it may have reached the next whole unit.
        each = each.withColumn("part", F.expr(f"cast(floor(mass / cast(degree as decimal(20,0))) as {MASS})"))
        part = F.expr("case when part * cast(degree as decimal(20,0)) > mass then part - 1 else part end")
        share = F.floor(part * F.lit(DAMPING) / F.lit(100)).cast(MASS)
        passed = each.select(F.col("to").alias("host"), share.alias("mass"))
        new = stored(passed.unionByName(home).groupBy("host").agg(F.sum("mass").cast(MASS).alias("mass")), "mass")
        both = new.join(mass.select("host", F.col("mass").alias("before")), "host", "full")
        zero = F.lit(0).cast(MASS)
        moved = both.agg(F.sum(F.abs(F.coalesce("mass", zero) - F.coalesce("before", zero))).alias("moved")).first()["moved"]
        mass = new
        if int(moved) * SETTLED <= UNITS:
            return mass


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages(page_id, url, html, …)``.

    * A null url or one without ``://`` has an empty host and path; no rule and no link concerns it, so it is allowed.
    * Trusted hosts have at least one page that a rule allows and none that a rule blocks, blocked
      hosts the other way round; a host with both kinds is no seed.
    * Null html has no links. Repeated rows give repeated result rows. Links are counted once per
      pair of hosts. Without links only seeds have mass. Other columns are ignored whatever their names.
    """
    where = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    ruled = where.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    kinds = ruled.where("rule is not null").groupBy("host").agg(
        F.bool_or(F.col("by_rule") == "allow").alias("good"), F.bool_or(F.col("by_rule") == "block").alias("bad")
    )
    seeds = stored(kinds, "kinds")
    links = stored(host_links(pages), "host-links")
    trust = spread(links, seeds.where("good and not bad").select("host"), "src", "dst")
    distrust = spread(links, seeds.where("bad and not good").select("host"), "dst", "src")
    zero = F.lit(0).cast(MASS)
    scores = (
        trust.select("host", F.col("mass").alias("trust"), zero.alias("distrust"))
        .unionByName(distrust.select("host", zero.alias("trust"), F.col("mass").alias("distrust")))
        .groupBy("host")
        .agg(F.sum("trust").cast(MASS).alias("trust"), F.sum("distrust").cast(MASS).alias("distrust"))
    )
    by_method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    # The scores of hosts without rules are all that is looked up; pages of a frequent host are split by skew joins.
    joined = ruled.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "trust", "distrust")


def allowed(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The rows of ``pages`` whose verdict is allow. Rows with one ``page_id`` and url share it."""
    bad = judge(pages, rules).where("verdict = 'block'").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    same = (host(pages["url"]) == bad["_host"]) & (path(pages["url"]) == bad["_path"])
    return pages.join(bad, same, "left_anti")
