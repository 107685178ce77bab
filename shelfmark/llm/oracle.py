"""Queries of this folder in DuckDB SQL, where SQL can express them: ``name -> SQL``."""

from __future__ import annotations

from . import decontaminate, prefix_trie, secrets, topk, url_filter
from .common import LOWER, UPPER

SQL: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_WORDS = f"regexp_extract_all({_lowered('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n FROM b WHERE len(w) > 0),
item_grams AS (SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
lengths AS (SELECT DISTINCT n FROM i),
doc_grams AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, s, n, item_id FROM doc_grams JOIN item_grams USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

SQL["op6_topk"] = f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {topk.K}
"""


def _spread(name: str, seeds: str, src: str, dst: str) -> str:
    """The rounds of one propagation, and its result after the first round that moves little, as common table expressions."""
    units, damping = url_filter.UNITS, url_filter.DAMPING
    home = units - units * damping // 100
    return f"""
{name}_n AS (SELECT count(*)::HUGEINT AS n FROM {seeds}),
{name}_e AS (SELECT {src} AS a, {dst} AS b, count(*) OVER (PARTITION BY {src})::HUGEINT AS degree FROM links),
{name}_r AS (SELECT 0 AS k, host, {units}::HUGEINT // n AS mass FROM {seeds}, {name}_n
  UNION ALL SELECT k, host, sum(mass)::HUGEINT FROM (
    SELECT k + 1 AS k, b AS host, mass // degree * {damping} // 100 AS mass FROM {name}_r JOIN {name}_e ON a = host
    UNION ALL SELECT k + 1, s.host, {home}::HUGEINT // n FROM (SELECT DISTINCT k FROM {name}_r), {seeds} s, {name}_n)
  WHERE k < 70 AND EXISTS (FROM links) GROUP BY k, host),
{name}_moved AS (SELECT k, sum(abs(mass - before)) AS moved FROM (
    SELECT k, host, sum(mass) AS mass, sum(before) AS before FROM (
      SELECT k, host, mass, 0::HUGEINT AS before FROM {name}_r WHERE k > 0 UNION ALL SELECT k + 1, host, 0, mass FROM {name}_r WHERE k < 70) GROUP BY k, host)
  GROUP BY k),
{name} AS (SELECT host, mass FROM {name}_r WHERE k = (SELECT CASE WHEN EXISTS (FROM links) THEN min(k) ELSE 0 END FROM {name}_moved
  WHERE moved * {url_filter.SETTLED} <= {units}::HUGEINT))"""


def _rule() -> tuple[str, str]:
    rule, verdict = "NULL", "NULL"
    for kind, prefix in sorted(url_filter.RULES, key=lambda r: len(r[1])):
        name, slash, rest = prefix.partition("/")
        fits = f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{prefix}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return rule, verdict


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


_RULE, _VERDICT = _rule()
SQL["op5_url_filter"] = f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS html, {_host("coalesce(url, '')")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS by_rule FROM p),
kinds AS (SELECT host, bool_or(by_rule = 'allow') AS good, bool_or(by_rule = 'block') AS bad FROM ruled WHERE rule IS NOT NULL GROUP BY host),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, {_quoted(url_filter.LINK)}, 1)) AS link FROM p),
links AS (SELECT DISTINCT src, dst FROM (SELECT src, {_host("'x://'||regexp_replace(link, '^.*//', '')")} AS dst FROM found)
  WHERE src <> '' AND dst <> '' AND src <> dst),
good AS (SELECT host FROM kinds WHERE good AND NOT bad), bad AS (SELECT host FROM kinds WHERE bad AND NOT good),
{_spread("t", "good", "src", "dst")},
{_spread("u", "bad", "dst", "src")}
SELECT page_id, r.host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(u.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN t ON t.host = r.host LEFT JOIN u ON u.host = r.host
"""

_SPACE = "chr(32)||chr(9)||chr(11)||chr(12)||chr(13)"
SQL["op8_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, s - 1 AS line, l[s] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS s FROM d)),
plain AS (SELECT doc_id, line, string_split(translate(text, '{UPPER}'||{_SPACE}, '{LOWER}     '), ' ') AS w FROM each),
sets AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(w, lambda x: x <> ''))) AS w FROM plain),
filled AS (SELECT * FROM sets WHERE len(w) > 0),
lone AS (SELECT w, min(struct_pack(doc_id := doc_id, line := line)) AS first, row_number() OVER () AS id FROM filled GROUP BY w),
words AS (SELECT id, unnest(w) AS word FROM lone),
counted AS (SELECT word, count(*) AS df FROM words GROUP BY word),
ranked AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM words JOIN counted USING (word)),
prefix AS (SELECT r.id, r.word FROM ranked r JOIN lone USING (id) WHERE place <= len(w) - ceil(len(w) * 4 / 5.0) + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.id <> b.id),
late AS (SELECT DISTINCT x FROM pairs JOIN lone p ON p.id = x JOIN lone q ON q.id = y
  WHERE q.first < p.first AND 5 * least(len(p.w), len(q.w)) >= 4 * greatest(len(p.w), len(q.w))
  AND 9 * len(list_intersect(p.w, q.w)) >= 4 * (len(p.w) + len(q.w))),
gone AS (SELECT f.doc_id, f.line FROM filled f JOIN lone p USING (w) LEFT JOIN late ON late.x = p.id
  WHERE late.x IS NOT NULL OR struct_pack(doc_id := f.doc_id, line := f.line) <> p.first),
listed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN listed USING (doc_id)
"""


def _spans(kind: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """``(r, kind, s, e, m)`` of all matches of a pattern in the texts of ``d``."""
    p = _quoted(pattern)
    return f"""SELECT r, {kind} AS kind, s, s + len(m) AS e, m FROM (
      SELECT r, CAST(list_sum(list_transform(gaps[:k], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: len(x))), 0) AS BIGINT) AS s, ms[k] AS m, gs[k] AS g
      FROM (SELECT r, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS gs,
        unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS k FROM d WHERE regexp_matches(text, {p}))) WHERE len(g) >= {least}"""


#: Runs of the characters of keys with all signs behind them that may be padding; whether they are shows the next character.
_KEY_RUN = "[A-Za-z0-9+/_-]{16,}=*"
_PLAIN_KEY = f"(len(core) = {secrets.WEAK_LENGTH} AND NOT regexp_matches(core, '[_-]') OR len(core) <= {secrets.WEAK_HEX} AND NOT regexp_matches(core, '[^0-9a-f]'))"
_MIXED_KEY = "(regexp_matches(core, '[0-9]') AND regexp_matches(core, '[A-Za-z]') OR regexp_matches(core, '[a-z][A-Z]'))"
_ENTROPY = """log2(len(core)) - list_sum(list_transform(list_distinct(string_split(core, '')),
  lambda c: (len(core) - len(replace(core, c, ''))) * log2(len(core) - len(replace(core, c, ''))))) / len(core)"""
_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
SQL["op10_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans(0, secrets.ASSIGN, 1, secrets.ASSIGN_LEAST)} UNION ALL {_spans(1, secrets.ACCESS)} UNION ALL {_spans(2, secrets.HEX)}),
runs AS (SELECT r, s, m, rtrim(m, '=') AS core, substr(text, s + len(m) + 1, 1) AS next FROM ({_spans(3, _KEY_RUN)}) JOIN d USING (r)),
weak AS (SELECT r, kind, s, e FROM ({_spans(3, secrets.RUN)}) WHERE len(m) = {secrets.WEAK_LENGTH} OR len(m) <= {secrets.WEAK_HEX} AND NOT regexp_matches(m, '[^0-9a-f]')
  UNION SELECT r, 3, s, s + CASE WHEN len(m) - len(core) IN (1, 2) AND NOT regexp_matches(next, '[A-Za-z0-9+/_-]') THEN len(m) ELSE len(core) END
  FROM runs WHERE NOT {_PLAIN_KEY} AND NOT regexp_full_match(core, '(?:{secrets.HEX}|{secrets.ACCESS})') AND ({_MIXED_KEY} OR {_ENTROPY} >= {secrets.ENTROPY})),
parts AS ({_spans(4, secrets.IDENTIFIER)} UNION ALL {_spans(4, secrets.ACCESS)} UNION ALL {_spans(5, secrets.ENDPOINT)}),
met AS (SELECT w.r, w.kind AS wk, w.s AS ws, w.e AS we, p.kind AS pk, p.s AS ps, p.e AS pe FROM weak w JOIN parts p USING (r)
  WHERE (p.s >= w.e AND p.s - w.e <= {secrets.SCOPE}) OR (p.e <= w.s AND w.s - p.e <= {secrets.SCOPE})),
spans AS (SELECT r, kind, s, e, true AS base FROM base UNION ALL
  SELECT DISTINCT r, kind, s, e, false FROM (SELECT r, wk AS kind, ws AS s, we AS e FROM met UNION ALL SELECT r, pk, ps, pe FROM met)),
named AS (SELECT *, {_NAMES}[kind + 1]||':'||s||':'||e AS name FROM spans),
text AS (SELECT r, count(*) FILTER (base AND kind = 0) AS a, count(*) FILTER (base AND kind = 1) AS b, count(*) FILTER (base AND kind = 2) AS c,
  string_agg(name, ',' ORDER BY s, kind, e) FILTER (base) AS base, string_agg(name, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN text USING (r)
"""

#: CRC-32 of a decimal number, bit by bit: a character is mixed in (its code), then eight steps follow (-1 each).
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"""

SQL["op12_prefix_trie"] = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n FROM t),
h AS (SELECT c, c - c % {prefix_trie.FAMILY} AS base, {_CRC32.format("CAST(c AS VARCHAR)")} % {prefix_trie.BORROWED} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, o.n AS k, role, text FROM h JOIN o ON o.c = h.base AND o.n <= h.h
  UNION ALL SELECT h.c, 1000000000 + o.n, role, text FROM h JOIN o ON o.c = h.c AND o.n > h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, role, text FROM r),
l AS (SELECT h.c, coalesce(max(d), 0) AS len FROM h LEFT JOIN s USING (c) GROUP BY h.c),
p AS (SELECT c, 0 AS d, '' AS key, 0 AS size FROM l
  UNION ALL SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d), strlen(text) FROM s),
m AS (SELECT key, d, min(size) AS size, min(c) AS conv_id, count(*) AS n,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '') AS ends FROM p JOIN l USING (c) GROUP BY key, d),
x AS (SELECT *, left(key, (d - 1) * 64) AS up FROM m),
k AS (SELECT up AS key, d - 1 AS d, count(*) AS children FROM x WHERE d > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(children, 0) AS children, a.conv_id AS parent
  FROM x LEFT JOIN k USING (key, d) LEFT JOIN m a ON x.d > 0 AND a.d = x.d - 1 AND a.key = x.up),
z AS (SELECT a.key, sum((u.n - 1) * u.size) AS saved, count(*) FILTER (u.children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM y) u JOIN y a ON a.d = e AND a.key = left(u.key, e * 64) GROUP BY a.key)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM y JOIN z USING (key)
"""
