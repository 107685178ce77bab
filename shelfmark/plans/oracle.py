"""The registered queries in DuckDB SQL, for comparison.

Each text is a list of common table expressions plus a final select. The expressions are
pieces shared by several queries; ``CTES`` maps a piece to the pieces it reads and its SQL.
"""

from __future__ import annotations

from ..functions.languages import LANGUAGE_BY_EXTENSION, LANGUAGE_BY_NAME
from ..functions.tokens import PIECE, TERM, TOKEN
from ..functions.vectors import DIMENSIONS, FAMILY_DIMENSIONS, MODEL_DIMENSIONS
from ..operators import context
from ..sources.batches import ENDPOINT
from . import queries as q, views

EXT_RE = r"^\.*[^.].*?(\.[^.]*)$"
WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TERM}')"


def path_terms(x: str) -> str:
    spaced = f"regexp_replace({x}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g')"
    return f"regexp_extract_all(lower({spaced}), '[\\p{{L}}\\p{{N}}]+')"


def cut(x: str, n: str) -> str:
    return f"array_to_string(list_slice(regexp_extract_all({x}, '{PIECE}'), 1, greatest({n}, 0)), '')"


def file_name(p: str) -> str:
    return f"split_part({p}, '/', -1)"


def raw_ext(p: str) -> str:
    return f"regexp_extract({file_name(p)}, '{EXT_RE}', 1)"


def dirs(p: str) -> str:
    return f"list_slice(string_split({p}, '/'), 1, -2)"


def bucket(key: str, n: int) -> str:
    return f"(('0x'||substr(md5({key}), 1, 4))::BIGINT % {n})"


def url(path: str, ns: str, host: str = "https://github.com", branch: str = "main") -> str:
    return f"'{host}/'||{ns}||'/blob/{branch}/'||substr({path}, length({ns}) + 2)"


def matches(rules) -> str:
    exts = _list(v.lower() for k, v in rules if k == "ext")
    files = _list(v for k, v in rules if k == "file")
    folders = _list(v for k, v in rules if k == "dir")
    return (
        f"(list_contains({exts}, lower({raw_ext('file_path')})) OR list_contains({files}, {file_name('file_path')}) "
        f"OR list_has_any({folders}, {dirs('file_path')}))"
    )


VISIBLE = "NOT regexp_matches(file_path, '(^|/)\\.')"


def _case(value: str, table: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


LANGUAGE = f"coalesce({_case(file_name('file_path'), LANGUAGE_BY_NAME)}, {_case(raw_ext('file_path'), LANGUAGE_BY_EXTENSION)})"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (list(needs), sql)


def compose(final: str, *needs: str) -> str:
    """The final select behind all pieces it needs, in order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in seen:
            seen.append(name)

    for need in needs:
        visit(need)
    parts = [f"{name} AS ({CTES[name][1]})" for name in seen]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


# --- views ----------------------------------------------------------------------------

cte(
    "files_v",
    f"""SELECT doc_id, 'acme/'||source AS namespace,
 'acme/'||source||'/'||({_list(views.FOLDERS)})[1 + doc_id % {len(views.FOLDERS)}]||'/d'||doc_id||'/'
 ||CASE WHEN doc_id % 50 = 0 THEN '__init__' ELSE 'doc_'||doc_id END
 ||({_list(views.EXTENSIONS)})[1 + doc_id % {len(views.EXTENSIONS)}] AS file_path, text AS content FROM documents""",
)
cte(
    "mangled_v",
    """SELECT doc_id, namespace, file_path, CASE doc_id % 6 WHEN 0 THEN '/'||file_path
 WHEN 1 THEN array_to_string(string_split(file_path, '/')[2:], '/')
 WHEN 2 THEN 'acme/'||array_to_string(string_split(file_path, '/')[3:], '/')
 WHEN 3 THEN array_to_string(string_split(file_path, '/')[3:], '/')
 WHEN 4 THEN regexp_replace(file_path, '..(\\.[^.]*)$', 'zz\\1') ELSE 'no file fits' END AS guess FROM files_v""",
    "files_v",
)
cte(
    "fixed_v",
    """SELECT doc_id, namespace, file_path, guess, CASE
 WHEN p[1] = o[1] AND len(p) > 1 AND p[2] = o[2] THEN bare
 WHEN p[1] = o[1] THEN array_to_string(list_concat(o, p[2:]), '/')
 WHEN p[1] = o[2] THEN o[1]||'/'||bare ELSE namespace||'/'||bare END AS path
 FROM (SELECT *, regexp_replace(guess, '^/', '') AS bare, string_split(regexp_replace(guess, '^/', ''), '/') AS p,
 string_split(namespace, '/') AS o FROM mangled_v)""",
    "mangled_v",
)
cte(
    "issues_raw",
    """SELECT conv_id, 'api/issue/'||conv_id AS url, 'issue/'||conv_id AS html_url,
 string_split(text, chr(10))[1] AS title, CASE WHEN conv_id % 10 <> 0 THEN text END AS body,
 conv_id % 7 = 0 AS is_pull FROM conversations WHERE turn = 0""",
)
cte(
    "comments_v",
    "SELECT conv_id, 'issue/'||conv_id AS html_url, turn, 'issue/'||conv_id||'#'||turn AS comment_url, text AS body"
    " FROM conversations WHERE turn >= 1 OR conv_id % 10 = 0",
)
cte(
    "issues_v",
    """SELECT url, html_url, title, coalesce(body, '') AS body, coalesce(n, 0) AS n,
 coalesce(bodies, []) AS bodies, coalesce(urls, '') AS urls FROM issues_raw i LEFT JOIN (SELECT conv_id, count(*) AS n,
 list(body ORDER BY turn) AS bodies, string_agg(comment_url, ',' ORDER BY turn) AS urls
 FROM comments_v GROUP BY conv_id) c USING (conv_id) WHERE NOT is_pull""",
    "issues_raw",
    "comments_v",
)
cte("code_keys", "SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem")
cte(
    "code_v",
    """SELECT k, 'acme/code' AS namespace, 'acme/code/o'||k||'.py' AS file_path,
 'class Order'||k||':'||chr(10)||string_agg('    def '||CASE WHEN n % 2 = 0 AND k % 5 = 0 THEN '_hidden_' ELSE 'line_' END
 ||n||'(self):'||chr(10)||'        return '||n||chr(10)||CASE WHEN k % 3 = 0 THEN '        def inner():'||chr(10)
 ||'            return 0'||chr(10) ELSE '' END, '' ORDER BY n)
 ||CASE WHEN k % 2 = 0 THEN 'def helper_'||k||'():'||chr(10)||'    return '||k||chr(10) ELSE '' END AS content
 FROM code_keys GROUP BY k""",
    "code_keys",
)
cte(
    "symbols_v",
    """SELECT DISTINCT 'acme/code' AS namespace, 'acme/code/o'||k||'.py' AS file_path, 'Order'||k AS class_name, NULL AS method_name
 FROM code_keys UNION ALL SELECT 'acme/code', 'acme/code/o'||k||'.py', 'Order'||k,
 CASE WHEN n % 2 = 0 AND k % 5 = 0 THEN '_hidden_' ELSE 'line_' END||n FROM code_keys
 UNION ALL SELECT DISTINCT 'acme/code', 'acme/code/o'||k||'.py', NULL, 'helper_'||k FROM code_keys WHERE k % 2 = 0""",
    "code_keys",
)
_POLYGLOT_PATH = f"'acme/code/p'||k||({_list(p[0] for p in views.POLYGLOT)})[1 + k % {len(views.POLYGLOT)}]"
cte(
    "polyglot_symbols",
    f"""SELECT DISTINCT {_POLYGLOT_PATH} AS file_path, 'Order'||k AS class_name, NULL AS method_name FROM code_keys
 UNION ALL SELECT {_POLYGLOT_PATH}, 'Order'||k, 'line_'||n FROM code_keys
 UNION ALL SELECT DISTINCT {_POLYGLOT_PATH}, NULL, 'helper_'||k FROM code_keys WHERE k % {len(views.POLYGLOT)} >= {views.MEMBERS_ONLY}""",
    "code_keys",
)
cte(
    "qrels_v",
    "SELECT b.item_id AS query_id, d.doc_id, 1 AS relevance FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
cte(
    "jobs_v",
    """SELECT event_id AS job_id, user_id AS dataset, CASE WHEN event_type IN ('purchase', 'view') THEN 'completed'
 WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'in_progress' ELSE 'validating' END AS status,
 CASE WHEN event_id % 11 <> 0 THEN 'file-'||event_id END AS output_file_id FROM events""",
)
cte(
    "path_questions",
    """SELECT DISTINCT namespace, split_part(namespace, '/', 2)||' '||folder AS query_id,
 'which '||folder||' files and tests exist' AS question FROM (SELECT namespace,
 array_to_string(list_slice(string_split(file_path, '/'), 3, len(string_split(file_path, '/')) - 2), ' ') AS folder FROM files_v)""",
    "files_v",
)

# --- chunking -------------------------------------------------------------------------


def _packed(prefix: str, lines: str, keys: list[str]) -> None:
    """Lines ``(namespace, *keys, b, i, t)`` to units ``(…, u, t, c)`` and their groups ``(*keys, u, g)``."""
    k, same = ", ".join(keys), " AND ".join(f"x.{c} = r.{c}" for c in keys)
    cte(
        f"{prefix}_sentences",
        f"""SELECT namespace, {k}, b, i, unnest(range(1, len(s) + 1)) AS j, unnest(s) AS t FROM (SELECT *, CASE
 WHEN {tok('t')} <= b THEN [t] ELSE string_split(regexp_replace(t, '([.!?])(\\s)', '\\1'||chr(1)||'\\2', 'g'), chr(1)) END AS s
 FROM {lines})""",
        lines,
    )
    cte(
        f"{prefix}_units",
        f"""SELECT namespace, {k}, b, t, {tok('t')} AS c, row_number() OVER (PARTITION BY {k} ORDER BY i, j, m) AS u
 FROM (SELECT namespace, {k}, b, i, j, unnest(range(1, len(p) + 1)) AS m, unnest(p) AS t FROM (SELECT *, CASE
 WHEN {tok('t')} <= b THEN [t] ELSE list_transform(range(CAST(ceil(len(regexp_extract_all(t, '{PIECE}')) / b) AS BIGINT)),
 lambda g: array_to_string(list_slice(regexp_extract_all(t, '{PIECE}'), g * b + 1, g * b + b), '')) END AS p
 FROM {prefix}_sentences))""",
        f"{prefix}_sentences",
    )
    x = ", ".join(f"x.{c}" for c in keys)
    cte(
        f"{prefix}_packed",
        f"""SELECT {k}, u, 0 AS g, c AS cur FROM {prefix}_units WHERE u = 1 UNION ALL
 SELECT {x}, x.u, CASE WHEN r.cur + x.c <= x.b THEN r.g ELSE r.g + 1 END,
 CASE WHEN r.cur + x.c <= x.b THEN r.cur + x.c ELSE x.c END
 FROM {prefix}_packed r JOIN {prefix}_units x ON {same} AND x.u = r.u + 1""",
        f"{prefix}_units",
    )


def _lines(prefix: str, source: str, limit: int) -> None:
    cte(
        f"{prefix}_lines",
        f"""SELECT namespace, file_path, {limit} - {tok('file_path')} AS b, i, t, {tok('t')} AS c,
 CASE WHEN trim(t, {WS}) <> '' THEN length(t) - length(ltrim(t, ' '||chr(9))) END AS ind
 FROM (SELECT namespace, file_path, unnest(range(1, len(l) + 1)) AS i,
 unnest(list_transform(l, lambda x, j: CASE WHEN j < len(l) THEN x||chr(10) ELSE x END)) AS t
 FROM (SELECT *, string_split(content, chr(10)) AS l FROM {source}))""",
        source,
    )


def _chunk_text(prefix: str, limit: int, source: str = "files_v") -> None:
    _lines(prefix, source, limit)
    _packed(prefix, f"{prefix}_lines", ["file_path"])
    _trimmed(prefix, f"SELECT x.*, r.g FROM {prefix}_units x JOIN {prefix}_packed r USING (file_path, u)", f"{prefix}_packed")


def _trimmed(prefix: str, grouped: str, *needs: str) -> None:
    """Groups of units to chunk rows with trimmed offsets."""
    cte(
        prefix,
        f"""SELECT namespace, file_path, s + length(t) - length(ltrim(t, {WS})) AS start_pos,
 s + length(rtrim(t, {WS})) AS end_pos, CAST(c + {tok('file_path')} AS BIGINT) AS num_tokens,
 file_path||chr(10)||chr(10)||trim(t, {WS}) AS text FROM (SELECT namespace, file_path, g, min(begins) AS s,
 string_agg(t, '' ORDER BY u) AS t, sum(c) AS c FROM (SELECT *, CAST(coalesce(sum(length(t)) OVER (PARTITION BY file_path
 ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM ({grouped})) GROUP BY ALL)
 WHERE trim(t, {WS}) <> ''""",
        *needs,
    )


_chunk_text("chunks", q.TEXT_TOKENS)
_chunk_text("half_chunks", q.TEXT_TOKENS // 2)
CHUNK_ID = "regexp_replace(file_path, '[^\\x00-\\x7F]', '', 'g')||'_'||start_pos||'_'||end_pos"

cte(
    "half_numbered",
    f"SELECT *, {tok('file_path')} AS h, row_number() OVER (PARTITION BY file_path ORDER BY start_pos) AS u FROM half_chunks",
    "half_chunks",
)
cte(
    "half_merged",
    f"""SELECT file_path, u, 0 AS g, num_tokens AS cur FROM half_numbered WHERE u = 1 UNION ALL
 SELECT x.file_path, x.u, CASE WHEN r.cur + x.num_tokens < {q.TEXT_TOKENS - 50} THEN r.g ELSE r.g + 1 END,
 CASE WHEN r.cur + x.num_tokens < {q.TEXT_TOKENS - 50} THEN r.cur + x.num_tokens - x.h ELSE x.num_tokens END
 FROM half_merged r JOIN half_numbered x ON x.file_path = r.file_path AND x.u = r.u + 1""",
    "half_numbered",
)


def _chunk_code(prefix: str, source: str, limit: int) -> None:
    """Blocks by indentation at any depth, what is still too long as text, then the merge."""
    _lines(prefix, source, limit)
    cte(
        f"{prefix}_ends",
        f"""SELECT *, coalesce((SELECT min(y.i) FROM {prefix}_lines y WHERE y.file_path = x.file_path AND y.i > x.i AND y.ind <= x.ind), 1000000000) AS e
 FROM {prefix}_lines x WHERE ind IS NOT NULL""",
        f"{prefix}_lines",
    )
    # A line belongs to the outermost block around it that fits, or else is a piece by itself.
    cte(
        f"{prefix}_sums",
        f"""SELECT x.file_path, x.i, x.e, (SELECT sum(y.c) FROM {prefix}_lines y WHERE y.file_path = x.file_path AND y.i >= x.i AND y.i < x.e) AS block
 FROM {prefix}_ends x""",
        f"{prefix}_ends",
    )
    cte(
        f"{prefix}_keys",
        f"""SELECT x.file_path, x.i, coalesce(min(a.i), x.i) AS k FROM {prefix}_ends x
 LEFT JOIN {prefix}_sums a ON a.file_path = x.file_path AND a.i <= x.i AND x.i < a.e AND a.block <= x.b GROUP BY x.file_path, x.i""",
        f"{prefix}_sums",
    )
    cte(
        f"{prefix}_blocks",
        f"""SELECT *, sum(c) OVER (PARTITION BY file_path, k1, k2) AS n FROM (SELECT *, 0 AS k2,
 CASE WHEN whole <= b THEN 0 ELSE coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY i), 0) END AS k1
 FROM (SELECT l.*, sum(c) OVER (PARTITION BY file_path) AS whole, k FROM {prefix}_lines l LEFT JOIN {prefix}_keys USING (file_path, i)))""",
        f"{prefix}_keys",
    )
    cte(f"{prefix}_long", f"SELECT namespace, file_path, k1, k2, b, i, t FROM {prefix}_blocks WHERE n > b", f"{prefix}_blocks")
    _packed(f"{prefix}_rest", f"{prefix}_long", ["file_path", "k1", "k2"])
    cte(
        f"{prefix}_units",
        f"""SELECT namespace, file_path, {tok('file_path')} AS h, t, c, row_number() OVER (PARTITION BY file_path ORDER BY k1, k2, g) AS u
 FROM (SELECT namespace, file_path, k1, k2, 0 AS g, string_agg(t, '' ORDER BY i) AS t, sum(c) AS c FROM {prefix}_blocks
 WHERE n <= b GROUP BY ALL UNION ALL SELECT namespace, file_path, k1, k2, g, string_agg(t, '' ORDER BY u), sum(c)
 FROM {prefix}_rest_units JOIN {prefix}_rest_packed USING (file_path, k1, k2, u) GROUP BY ALL)""",
        f"{prefix}_rest_packed",
    )
    # White space in front of the first token is in no group and only moves the offsets.
    cte(
        f"{prefix}_merged",
        f"""SELECT file_path, u, 0 AS g, c AS cur FROM {prefix}_units WHERE u = 1 UNION ALL
 SELECT x.file_path, x.u, CASE WHEN x.c = 0 OR r.cur = 0 OR 2 * x.h + r.cur + x.c < {limit - 50} THEN r.g ELSE r.g + 1 END,
 CASE WHEN x.c = 0 OR r.cur = 0 OR 2 * x.h + r.cur + x.c < {limit - 50} THEN r.cur + x.c ELSE x.c END
 FROM {prefix}_merged r JOIN {prefix}_units x ON x.file_path = r.file_path AND x.u = r.u + 1""",
        f"{prefix}_units",
    )
    _trimmed(
        prefix, f"SELECT x.*, r.g FROM {prefix}_units x JOIN {prefix}_merged r USING (file_path, u)", f"{prefix}_merged"
    )


_chunk_code("code_chunks", "code_v", q.CODE_TOKENS)
cte(
    "notebook_files",
    "SELECT namespace, replace(file_path, '.py', '.ipynb') AS file_path, rtrim(content, chr(10)) AS content FROM code_v",
    "code_v",
)
_chunk_code("notebook_chunks", "notebook_files", q.CODE_TOKENS)
cte("text_files", f"SELECT * FROM files_v WHERE coalesce({LANGUAGE}, 'text only') = 'text only'", "files_v")
cte("code_files", f"SELECT * FROM files_v WHERE {LANGUAGE} <> 'text only'", "files_v")
_chunk_text("text_parts", q.TEXT_TOKENS, "text_files")
_chunk_code("code_parts", "code_files", q.TEXT_TOKENS)
cte(
    "any_chunks",
    "SELECT *, 'text' AS chunker FROM text_parts UNION ALL SELECT *, 'code' FROM code_parts",
    "text_parts",
    "code_parts",
)

def _chunk_issue(prefix: str, limit: int) -> None:
    cte(
        f"{prefix}_costs",
        f"""SELECT html_url, title, bodies, n, '# Issue: '||title AS line, CASE WHEN {tok("'# Issue: '||title||chr(10)||body")} > {limit}
 THEN '# Issue: '||title||chr(10)||{cut('body', f"{limit - 20} - {tok('title')}")}
 ELSE '# Issue: '||title||chr(10)||body END AS head FROM issues_v""",
        "issues_v",
    )
    cte(
        f"{prefix}_packed",
        f"""SELECT html_url, 0::BIGINT AS i, 0::BIGINT AS g, 0::BIGINT AS a, {tok('head')} AS cur FROM {prefix}_costs UNION ALL
 SELECT r.html_url, r.i + 1, CASE WHEN r.cur + {tok('x.bodies[r.i + 1]')} + 20 > {limit} THEN r.g + 1 ELSE r.g END,
 CASE WHEN r.cur + {tok('x.bodies[r.i + 1]')} + 20 > {limit} THEN r.i ELSE r.a END,
 CASE WHEN r.cur + {tok('x.bodies[r.i + 1]')} + 20 > {limit} THEN {tok('x.line')} ELSE r.cur END + 4 + {tok('x.bodies[r.i + 1]')}
 FROM {prefix}_packed r JOIN {prefix}_costs x ON x.html_url = r.html_url AND r.i < x.n""",
        f"{prefix}_costs",
    )
    cte(
        prefix,
        f"""SELECT html_url||'_'||a||'_'||e AS chunk_id, html_url AS url, a AS start_comment, e AS end_comment,
 {tok('text')} AS num_tokens, text FROM (SELECT *, CASE WHEN g = 0 THEN head ELSE line END||chr(10)||chr(10)
 ||array_to_string(list_transform(list_slice(bodies, a + 1, e), lambda c: '## Comment: '||c), chr(10)||chr(10)) AS text
 FROM (SELECT html_url, g, max(a) AS a, max(i) AS e FROM {prefix}_packed GROUP BY html_url, g) JOIN {prefix}_costs USING (html_url))""",
        f"{prefix}_packed",
    )


_chunk_issue("issue_chunks", q.ISSUE_TOKENS)
_chunk_issue("indexed_issue_chunks", q.TEXT_TOKENS)

# --- batches --------------------------------------------------------------------------

cte(
    "batched",
    f"""SELECT *, namespace||'/'||batch_no AS batch_id FROM (SELECT *, rn // {q.BATCH} AS batch_no, rn % {q.BATCH} AS pos
 FROM (SELECT *, {CHUNK_ID} AS chunk_id, row_number() OVER (PARTITION BY namespace
 ORDER BY {bucket('file_path', 4096)}, file_path, start_pos) - 1 AS rn FROM chunks))""",
    "chunks",
)
cte(
    "vector_batches",
    f"""SELECT *, label||'/'||(rn // {q.BATCH}) AS batch_id, rn % {q.BATCH} AS pos FROM (SELECT *, row_number() OVER (
 PARTITION BY label ORDER BY {bucket("vec_id::VARCHAR", 4096)}, vec_id) - 1 AS rn FROM embeddings)""",
)
cte(
    "budget_rows",
    f"""SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY {bucket('file_path', 4096)}, file_path, start_pos) AS u
 FROM (SELECT *, {CHUNK_ID} AS chunk_id FROM chunks)""",
    "chunks",
)
_OPEN = f"(r.pos + 2 <= {q.BATCH} AND r.cur + x.num_tokens <= {q.BATCH_TOKENS})"
cte(
    "budget_packed",
    f"""SELECT namespace, u, chunk_id, 0::BIGINT AS no, 0::BIGINT AS pos, num_tokens AS cur FROM budget_rows WHERE u = 1 UNION ALL
 SELECT x.namespace, x.u, x.chunk_id, CASE WHEN {_OPEN} THEN r.no ELSE r.no + 1 END,
 CASE WHEN {_OPEN} THEN r.pos + 1 ELSE 0 END, CASE WHEN {_OPEN} THEN r.cur ELSE 0 END + x.num_tokens
 FROM budget_packed r JOIN budget_rows x ON x.namespace = r.namespace AND x.u = r.u + 1""",
    "budget_rows",
)

# --- sparse, dense and fused retrieval ---------------------------------------------------


def _ranked(scores: str, k: int, name: str, *needs: str) -> None:
    cte(
        name,
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"
        f" FROM ({scores})) WHERE rank <= {k}",
        *needs,
    )


def _bm25(name: str, docs: str, asked: str, k: int, *needs: str) -> None:
    """BM25 of ``docs (doc_id, terms)`` for ``asked (query_id, terms)``."""
    cte(f"{name}_docs", docs, *needs)
    cte(
        f"{name}_tf",
        f"""SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM {name}_docs) GROUP BY ALL""",
        f"{name}_docs",
    )
    cte(f"{name}_df", f"SELECT term, count(*) AS df FROM {name}_tf GROUP BY term", f"{name}_tf")
    cte(f"{name}_totals", f"SELECT count(*) AS n, avg(len(terms)) AS a FROM {name}_docs", f"{name}_docs")
    cte(f"{name}_asked", f"SELECT DISTINCT query_id, unnest(terms) AS term FROM ({asked})", *needs)
    cte(
        f"{name}_weights",
        f"""SELECT query_id, doc_id, term, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))
 * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))) AS weight
 FROM {name}_asked JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_totals""",
        f"{name}_asked",
        f"{name}_df",
        f"{name}_totals",
    )
    _ranked(
        f"SELECT query_id, doc_id, sum(CAST(round(weight * 1e12) AS BIGINT))::DOUBLE / 1e12 AS score FROM {name}_weights GROUP BY ALL", k, name, f"{name}_weights"
    )


_bm25(
    "sparse",
    f"SELECT doc_id, {terms('text')} AS terms FROM documents",
    f"SELECT item_id AS query_id, {terms('text')} AS terms FROM benchmark",
    q.DEPTH,
)
_bm25(
    "variants",
    f"SELECT doc_id, {terms('text')} AS terms FROM documents",
    f"""SELECT item_id||'#'||(i - 1) AS query_id, {terms('t')} AS terms FROM (SELECT item_id, unnest(range(1, len(s) + 1)) AS i,
 unnest(s) AS t FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark))""",
    q.K,
)
_bm25(
    "by_path",
    f"""SELECT file_path AS doc_id, {path_terms('file_path')} AS terms FROM files_v UNION ALL
 SELECT f.file_path, list_concat({path_terms('f.file_path')}, coalesce(s.t, [])) FROM code_v f LEFT JOIN (SELECT file_path,
 flatten(list({path_terms("concat_ws(' ', class_name, method_name)")})) AS t FROM symbols_v GROUP BY file_path) s USING (file_path)""",
    f"SELECT query_id, {path_terms('question')} AS terms FROM path_questions",
    q.K,
    "files_v",
    "code_v",
    "symbols_v",
    "path_questions",
)


def _hashed(name: str, source: str) -> None:
    buckets = f"list_transform({terms('text')}, lambda t: ('0x'||substr(md5(t), 1, 4))::BIGINT % {DIMENSIONS})"
    cte(
        name,
        f"""SELECT id, list_transform(c, lambda x: CASE WHEN s > 0 THEN x / sqrt(s) ELSE 0e0 END) AS v FROM (SELECT id, c,
 list_sum(list_transform(c, lambda x: x * x)) AS s FROM (SELECT id, list_transform(range({DIMENSIONS}),
 lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM (SELECT id, {buckets} AS b FROM ({source}))))""",
    )


_hashed("doc_vectors", "SELECT doc_id AS id, text FROM documents")
_hashed("query_vectors", "SELECT item_id AS id, text FROM benchmark")
_ranked(
    "SELECT q.id AS query_id, d.id AS doc_id, round(coalesce(list_cosine_similarity(d.v, q.v), 0), 12) + 0e0 AS score FROM query_vectors q, doc_vectors d",
    q.DEPTH,
    "dense",
    "query_vectors",
    "doc_vectors",
)
cte(
    "vecs",
    "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
)
for _name, _score in {
    "cosine": "round(list_cosine_similarity(a.v, b.v), 12) + 0e0",
    "dot": "round(list_inner_product(a.v, b.v), 12) + 0e0",
    "l2_near": "-round(list_distance(a.v, b.v), 12)",
}.items():
    _ranked(
        f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_score} AS score FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id",
        q.K,
        _name,
        "vecs",
    )
cte("l2", "SELECT query_id, doc_id, 0e0 - score AS score, rank FROM l2_near", "l2_near")
_ranked(
    f"""SELECT query_id, doc_id, round(sum(w / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank, {q.ALPHA}e0 AS w FROM dense
 UNION ALL SELECT query_id, doc_id, rank, {1 - q.ALPHA}e0 FROM sparse) GROUP BY ALL""",
    q.DEPTH,
    "rrf",
    "dense",
    "sparse",
)
_SCALED = """SELECT query_id, doc_id, {w}e0 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1e0 END AS part FROM (SELECT *,
 min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {t})"""
_ranked(
    "SELECT query_id, doc_id, round(sum(part), 12) AS score FROM ("
    + _SCALED.format(w=q.ALPHA, t="dense")
    + " UNION ALL "
    + _SCALED.format(w=1 - q.ALPHA, t="sparse")
    + ") GROUP BY ALL",
    q.DEPTH,
    "weighted",
    "dense",
    "sparse",
)
OVERLAP = (
    f"CASE WHEN len(list_distinct({terms('b.text')})) > 0 THEN round(len(list_intersect(list_distinct({terms('b.text')}),"
    f" {terms('d.text')})) / len(list_distinct({terms('b.text')})), 6) ELSE 0 END"
)
cte(
    "pairs",
    f"""SELECT query_id, h.doc_id, h.rank, d.lang, ({OVERLAP})::DOUBLE AS overlap FROM sparse h JOIN documents d USING (doc_id)
 JOIN benchmark b ON b.item_id = h.query_id""",
    "sparse",
)
_ranked("SELECT query_id, doc_id, overlap AS score FROM pairs", 5, "reranked", "pairs")
_ranked(
    """SELECT query_id, doc_id, CASE WHEN fell_back THEN -rank::DOUBLE ELSE overlap END AS score, fell_back
 FROM (SELECT *, bool_or(lang = 'fr') OVER (PARTITION BY query_id) AS fell_back FROM pairs)""",
    5,
    "fallback",
    "pairs",
)

# --- evaluation -----------------------------------------------------------------------


def _metrics(name: str, judged: str, totals: str, *needs: str) -> None:
    cte(
        f"{name}_judged",
        f"""SELECT *, sum(relevance) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM ({judged})""",
        *needs,
    )
    cte(f"{name}_totals", totals, *needs)
    cte(
        f"{name}_scores",
        f"""SELECT query_id, coalesce(sum(CASE WHEN rank <= n THEN relevance END) / n, 0) AS rprec,
 coalesce(sum(CASE WHEN rank = 1 THEN relevance END), 0) AS p1,
 coalesce(sum(CASE WHEN rank <= 3 THEN relevance END) / n, 0) AS r3,
 coalesce(sum(CASE WHEN rank <= 3 THEN relevance / log2(rank + 1) END)
 / (1e0 + CASE WHEN n > 1 THEN 1 / log2(3) ELSE 0 END + CASE WHEN n > 2 THEN 1 / log2(4) ELSE 0 END), 0) AS ndcg3,
 coalesce(sum(CASE WHEN relevance > 0 THEN found / rank END) / n, 0) AS map,
 coalesce(1 / min(CASE WHEN relevance > 0 THEN rank END), 0) AS mrr
 FROM {name}_totals LEFT JOIN {name}_judged USING (query_id) GROUP BY query_id, n""",
        f"{name}_judged",
        f"{name}_totals",
    )
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("rprec", "p1", "r3", "ndcg3", "map", "mrr"))
    cte(f"{name}_report", f"SELECT '{name}' AS run_id, {means} FROM {name}_scores", f"{name}_scores")


for _name in ("cosine", "dot", "l2"):
    _metrics(
        _name,
        f"""SELECT query_id, rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS relevance FROM {_name} h
 JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.doc_id""",
        "SELECT vec_id AS query_id, n FROM (SELECT vec_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings) WHERE n > 0",
        _name,
    )
cte(
    "sparse_judged",
    "SELECT h.query_id, h.doc_id, h.score, h.rank, coalesce(r.relevance, 0)::BIGINT AS relevance FROM sparse h LEFT JOIN qrels_v r USING (query_id, doc_id)",
    "sparse",
    "qrels_v",
)
_metrics(
    "bm25",
    "SELECT query_id, rank, relevance FROM sparse_judged",
    "SELECT query_id, count(*) AS n FROM qrels_v GROUP BY query_id",
    "sparse_judged",
)

for _name in ("sparse", "dense", "rrf"):
    _metrics(
        f"{_name}_run",
        f"SELECT h.query_id, h.rank, coalesce(r.relevance, 0) AS relevance FROM {_name} h LEFT JOIN qrels_v r USING (query_id, doc_id)",
        "SELECT query_id, count(*) AS n FROM qrels_v GROUP BY query_id",
        _name,
        "qrels_v",
    )
_METRIC_NAMES = ("rprec", "p1", "r3", "ndcg3", "map", "mrr")
cte(
    "run_values",
    " UNION ALL ".join(
        f"SELECT '{run}' AS run_id, query_id, '{m}' AS metric, {m}::DOUBLE AS value FROM {run}_run_scores"
        for run in ("sparse", "dense", "rrf") for m in _METRIC_NAMES
    ),
    "sparse_run_scores", "dense_run_scores", "rrf_run_scores",
)

# --- outline --------------------------------------------------------------------------

cte(
    "tree_paths",
    """SELECT namespace, file_path AS node_path, 2 AS need FROM files_v UNION ALL SELECT namespace, file_path, 2 FROM code_v
 UNION ALL SELECT namespace, file_path||'/'||class_name, 1 FROM symbols_v WHERE method_name IS NULL
 UNION ALL SELECT namespace, concat_ws('/', file_path, class_name, method_name), 0 FROM symbols_v
 WHERE method_name IS NOT NULL AND NOT starts_with(method_name, '_')""",
    "files_v",
    "code_v",
    "symbols_v",
)


def prefixes(source: str, path: str, extra: str = "") -> str:
    return (
        f"SELECT namespace{extra}, array_to_string(p[1:d], '/') AS node_path, d - 1 AS depth, p[d] AS name FROM (SELECT *, "
        f"unnest(range(1, len(p) + 1)) AS d FROM (SELECT *, string_split({path}, '/') AS p FROM {source}))"
    )


cte("tree_nodes", prefixes("tree_paths", "node_path", ", need"), "tree_paths")
cte(
    "tree_lines",
    f"""SELECT *, {tok('line')} AS tokens, replace(node_path, '/', chr(1)) AS o FROM (SELECT namespace, node_path, depth, max(need) AS need,
 repeat(' ', (4 * depth)::INT)||name AS line FROM tree_nodes GROUP BY namespace, node_path, depth, name)""",
    "tree_nodes",
)
_L = q.OUTLINE_TOKENS
cte(
    "outlines",
    f"""SELECT namespace, variant, CAST(sum(least(tokens, {_L} - begins)) AS BIGINT) AS n_tokens,
 string_agg(CASE WHEN tokens > {_L} - begins THEN {cut('line', f"({_L} - begins)")} ELSE line END, chr(10) ORDER BY o) AS outline
 FROM (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY namespace ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
 FROM tree_lines JOIN (SELECT namespace, CASE WHEN t0 <= {_L} THEN 0 WHEN t1 <= {_L} THEN 1 ELSE 2 END AS level,
 CASE WHEN t0 <= {_L} THEN 'methods' WHEN t1 <= {_L} THEN 'classes' WHEN t2 <= {_L} THEN 'files' ELSE 'truncated' END AS variant
 FROM (SELECT namespace, sum(tokens) AS t0, coalesce(sum(tokens) FILTER (need >= 1), 0) AS t1,
 coalesce(sum(tokens) FILTER (need >= 2), 0) AS t2 FROM tree_lines GROUP BY namespace)) USING (namespace) WHERE need >= level)
 WHERE begins < {_L} GROUP BY namespace, variant""",
    "tree_lines",
)
cte(
    "history",
    """SELECT conv_id, turn, role, text, coalesce(string_agg(role||': '||text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""",
)
cte(
    "nearest",
    """SELECT namespace, guess, min(d) AS distance, min_by(file_path, d * 1000000 + r) AS file_path FROM (SELECT g.namespace, g.path AS guess, f.file_path,
 levenshtein(g.path, f.file_path) AS d, row_number() OVER (PARTITION BY g.namespace, g.path ORDER BY f.file_path) AS r
 FROM (SELECT DISTINCT namespace, path FROM fixed_v) g JOIN files_v f USING (namespace)) WHERE d <= 10 GROUP BY namespace, guess""",
    "fixed_v",
    "files_v",
)


def _metric(column: str) -> str:
    return compose(f"SELECT round(avg({column}), 6) AS {column} FROM cosine_scores", "cosine_scores")


#: Queries with a column ``score``.
SCORED = (
    "hybrid_rrf", "hybrid_weighted", "join_qrels", "knn_cross", "multi_query_union", "rank_hits", "rerank_fallback", "rerank_topn",
    "retrieve_by_path", "retrieve_dense", "retrieve_sparse", "topk_bm25", "topk_cosine", "topk_dot", "topk_l2",
)


def oracle_sql() -> dict[str, str]:
    exclude, include = matches(views.EXCLUDE_RULES), matches(views.INCLUDE_RULES)
    models = [*MODEL_DIMENSIONS, "voyage-3", "other"]
    model = f"({_list(models)})[1 + doc_id % {len(models)}]"
    sizes = " ".join(f"WHEN model = '{m}' THEN {n}" for m, n in MODEL_DIMENSIONS.items()) + " ".join(
        f" WHEN starts_with(model, '{p}') THEN {n}" for p, n in FAMILY_DIMENSIONS.items()
    )
    route = f"CASE WHEN lower(file_path) LIKE '%.ipynb' THEN 'notebook' WHEN ({LANGUAGE}) <> 'text only' THEN 'code' ELSE 'text' END"
    repo = "array_to_string(string_split(guess, '/')[1:2], '/')"
    scored = """CASE query_id % 3 WHEN 0 THEN score WHEN 1 THEN -score ELSE round(1e0 / rank, 6) END"""
    versions = """SELECT 'acme/v'||(vec_id % 4) AS namespace, vec_id::VARCHAR AS chunk_id,
 (CASE WHEN label >= 5 THEN label + 100 ELSE label END)::BIGINT AS num_tokens"""
    sql = {
        # A
        "scan_files": compose("SELECT namespace, file_path, content FROM files_v", "files_v"),
        "decode_text": "SELECT page_id, regexp_replace(html, '\\r\\n?', chr(10), 'g') AS content FROM pages WHERE html <> ''",
        "scan_metadata_only": compose(f"SELECT file_path, {url('file_path', 'namespace')} AS url FROM files_v", "files_v"),
        "load_rules": compose(
            f"""SELECT DISTINCT 'ext' AS kind, lower({raw_ext('file_path')}) AS value FROM files_v
 UNION ALL SELECT DISTINCT 'dir', unnest(string_split(file_path, '/')[:-2]) FROM files_v""",
            "files_v",
        ),
        "scan_issues": compose(
            "SELECT url, html_url, title, body, n AS n_comments, urls AS comment_urls FROM issues_v", "issues_v"
        ),
        "scan_benchmark": compose(
            """SELECT ('0x'||substr(md5(text), 1, 15))::BIGINT AS query_id, doc_id::VARCHAR AS doc_id, 1::BIGINT AS relevance
 FROM qrels_v JOIN benchmark ON item_id = query_id""",
            "qrels_v",
        ),
        "scan_question_csv": "SELECT item_id::VARCHAR AS id, text AS question FROM benchmark",
        "write_predictions_csv": compose(
            """SELECT item_id AS id, coalesce(to_json(list(doc_id::VARCHAR ORDER BY rank) FILTER (doc_id IS NOT NULL))::VARCHAR, '[]') AS documents
 FROM benchmark LEFT JOIN sparse ON query_id = item_id AND rank <= 3 GROUP BY item_id""",
            "sparse",
        ),
        "write_batch_requests": compose(
            f"""SELECT batch_id, to_json({{'custom_id': batch_id, 'method': 'POST', 'url': '{ENDPOINT}', 'body': {{'model':
 'text-embedding-3-small', 'input': list(text ORDER BY pos), 'dimensions': 64}}}})::VARCHAR AS request FROM batched GROUP BY batch_id""",
            "batched",
        ),
        "read_batch_results": compose(
            """SELECT batch_id, pos, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM vector_batches""",
            "vector_batches",
        ),
        "write_eval_report": compose(
            """SELECT 'cosine' AS run_id, query_id, round(rprec, 6) AS rprec, round(map, 6) AS map, round(mrr, 6) AS mrr,
 string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS documents FROM cosine_scores JOIN cosine USING (query_id)
 GROUP BY query_id, rprec, map, mrr""",
            "cosine_scores",
            "cosine",
        ),
        "filter_audit": compose(
            f"SELECT namespace, file_path, {VISIBLE} AND NOT {exclude} AS included FROM files_v", "files_v"
        ),
        "export_index": "SELECT 'acme/v'||(vec_id % 4) AS namespace, vec_id::VARCHAR AS chunk_id, len(embedding) AS n FROM embeddings",
        "load_index": f"{versions} FROM embeddings",
        # B
        "filter_hidden": compose(f"SELECT file_path FROM files_v WHERE {VISIBLE}", "files_v"),
        "filter_include": compose(f"SELECT file_path FROM files_v WHERE {include}", "files_v"),
        "filter_exclude": compose(f"SELECT file_path FROM files_v WHERE NOT {exclude}", "files_v"),
        "path_parts": compose(
            f"""SELECT file_path, lower({raw_ext('file_path')}) AS ext, {file_name('file_path')} AS file_name,
 array_to_string({dirs('file_path')}, ',') AS dirs FROM files_v""",
            "files_v",
        ),
        "file_url": compose(
            f"SELECT file_path, {url('file_path', 'namespace', 'https://host.example', 'dev')} AS url FROM files_v", "files_v"
        ),
        "detect_language": compose(f"SELECT file_path, {LANGUAGE} AS language FROM files_v", "files_v"),
        "route_chunker": compose(
            f"""SELECT file_path, {route} AS chunker FROM (SELECT file_path FROM files_v UNION ALL
 SELECT file_path FROM notebook_files)""",
            "files_v",
            "notebook_files",
        ),
        "drop_stored_text": compose(
            f"SELECT {CHUNK_ID} AS chunk_id, NULL AS text FROM chunks UNION ALL SELECT chunk_id, text FROM issue_chunks",
            "chunks",
            "issue_chunks",
        ),
        "filter_failed_jobs": compose(
            """SELECT job_id, CASE WHEN status = 'failed' THEN 'failed' WHEN output_file_id IS NULL THEN 'no output' ELSE 'ok' END AS outcome FROM jobs_v""",
            "jobs_v",
        ),
        "limit_batches": compose("SELECT batch_id, pos, chunk_id FROM batched WHERE batch_no < 2", "batched"),
        "namespace_filter": compose(
            """SELECT namespace, file_path FROM files_v WHERE namespace = (SELECT 'acme/'||source FROM documents
 ORDER BY n_chars DESC, 'acme/'||source DESC LIMIT 1)""",
            "files_v",
        ),
        # C
        "count_tokens": f"SELECT doc_id, {tok('text')} AS num_tokens FROM documents",
        "truncate_tokens": f"SELECT doc_id, {cut('text', '50')} AS text FROM documents",
        "chunk_content": compose(f"SELECT {CHUNK_ID} AS chunk_id, text FROM chunks", "chunks"),
        "chunk_id": compose(
            """SELECT doc_id, CASE WHEN plain = p THEN p ELSE plain||'~'||substr(md5(p), 1, 16) END||'_0_'||length(content) AS chunk_id,
 length(content) AS length FROM (SELECT *, regexp_replace(p, '[^\\x00-\\x7F]', '', 'g') AS plain FROM
 (SELECT *, file_path||'/'||string_split(content, ' ')[1] AS p FROM files_v))""",
            "files_v",
        ),
        "issue_text": compose(
            """SELECT html_url||'_0_'||n AS chunk_id, html_url AS url, '# Issue: '||title||chr(10)||body||chr(10)||chr(10)
 ||array_to_string(list_transform(bodies, lambda c: '## Comment: '||c), chr(10)||chr(10)) AS text FROM issues_v""",
            "issues_v",
        ),
        "fix_path": compose("SELECT doc_id, path FROM fixed_v", "fixed_v"),
        "levenshtein_distance": compose("SELECT doc_id, levenshtein(guess, file_path) AS distance FROM mangled_v", "mangled_v"),
        "normalize_namespace": """SELECT doc_id, ns AS namespace, regexp_replace(ns, '[^a-zA-Z0-9_-]', '_', 'g') AS safe,
 replace(ns, '/', '_') AS dataset FROM (SELECT doc_id, 'acme/'||source||'/'||lang||'.x' AS ns FROM documents)""",
        "validate_repo_id": compose(
            f"SELECT doc_id, {repo} AS repo, regexp_matches({repo}, '^[^/]+/[^/]+$') AS valid FROM mangled_v", "mangled_v"
        ),
        "embedding_size": f"""SELECT doc_id, model, (CASE {sizes} ELSE 64 END)::BIGINT AS size
 FROM (SELECT doc_id, {model} AS model FROM documents)""",
        "source_links": compose(
            f"""SELECT query_id, string_agg('['||file_path||']('||{url('file_path', 'namespace')}||')', chr(10) ORDER BY rank) AS sources
 FROM sparse JOIN files_v USING (doc_id) GROUP BY query_id""",
            "sparse",
            "files_v",
        ),
        # D
        "chunk_text": compose(
            f"SELECT {CHUNK_ID} AS chunk_id, file_path, start_pos, end_pos, num_tokens, text FROM chunks", "chunks"
        ),
        "chunk_code": compose("SELECT file_path, start_pos, end_pos, num_tokens, text FROM code_chunks", "code_chunks"),
        "merge_small_chunks": compose(
            f"""SELECT * EXCLUDE (content), {CHUNK_ID} AS chunk_id, file_path||chr(10)||chr(10)||substr(content, start_pos + 1, end_pos - start_pos) AS text
 FROM (SELECT file_path, min(start_pos) AS start_pos, max(end_pos) AS end_pos, CAST(sum(num_tokens - h) + any_value(h) AS BIGINT) AS num_tokens
 FROM half_numbered JOIN half_merged USING (file_path, u) GROUP BY file_path, g) JOIN (SELECT file_path, content FROM files_v) USING (file_path)""",
            "half_merged",
            "files_v",
        ),
        "chunk_notebook": compose(
            "SELECT file_path, start_pos, end_pos, num_tokens, text FROM notebook_chunks", "notebook_chunks"
        ),
        "notebook_code": compose("SELECT file_path, content AS code FROM notebook_files", "notebook_files"),
        "chunk_issue": compose("SELECT * FROM issue_chunks", "issue_chunks"),
        "chunk_any": compose(
            "SELECT file_path, chunker, start_pos, end_pos, num_tokens, text FROM any_chunks", "any_chunks"
        ),
        "extract_symbols": compose(
            """SELECT file_path, class_name, method_name FROM symbols_v
 UNION ALL SELECT file_path, class_name, method_name FROM polyglot_symbols""",
            "symbols_v",
            "polyglot_symbols",
        ),
        "path_ancestors": compose(f"SELECT DISTINCT * FROM ({prefixes('files_v', 'file_path')})", "files_v"),
        # E
        "join_batch_results": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
        "join_issue_comments": compose(
            """SELECT html_url, title, coalesce(bodies, '') AS bodies FROM issues_raw LEFT JOIN (SELECT html_url,
 string_agg(body, '|' ORDER BY turn) AS bodies FROM comments_v GROUP BY html_url) USING (html_url)""",
            "issues_raw",
            "comments_v",
        ).replace("SELECT html_url, title,", "SELECT html_url,"),
        "validate_paths": compose(
            """SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY position, file_path) AS rank
 FROM (SELECT g.namespace AS query_id, coalesce(e.file_path, n.file_path) AS file_path, min(g.doc_id) AS position
 FROM fixed_v g LEFT JOIN (SELECT namespace, file_path FROM files_v) e ON e.namespace = g.namespace AND e.file_path = g.guess
 LEFT JOIN nearest n ON n.namespace = g.namespace AND n.guess = g.path AND contains(g.guess, '/')
 WHERE coalesce(e.file_path, n.file_path) IS NOT NULL GROUP BY ALL)""",
            "fixed_v",
            "nearest",
        ),
        "nearest_path": compose("SELECT namespace, guess, file_path, distance FROM nearest", "nearest"),
        "join_qrels": compose("SELECT * FROM sparse_judged", "sparse_judged"),
        "hydrate_files": compose(
            "SELECT query_id, rank, file_path, content FROM sparse JOIN files_v USING (doc_id) WHERE rank <= 3", "sparse", "files_v"
        ),
        "hydrate_text": compose(f"SELECT {CHUNK_ID} AS chunk_id, text FROM chunks", "chunks"),
        "postings_join": compose(
            "SELECT query_id, doc_id, term, round(weight, 6) AS weight FROM sparse_weights", "sparse_weights"
        ),
        "knn_cross": compose("SELECT query_id, doc_id, score, rank FROM cosine", "cosine"),
        # F
        "job_status_counts": compose("SELECT status, count(*) AS n FROM jobs_v GROUP BY status", "jobs_v"),
        "all_jobs_ready": compose(
            "SELECT dataset, bool_and(status IN ('completed', 'failed')) AS ready FROM jobs_v GROUP BY dataset", "jobs_v"
        ),
        "corpus_stats": compose(
            """SELECT namespace, count(DISTINCT file_path) AS n_files, count(*) AS n_chunks, CAST(sum(num_tokens) AS BIGINT) AS n_tokens,
 count(DISTINCT file_path) <= 200 AS is_small FROM chunks GROUP BY namespace""",
            "chunks",
        ),
        "bm25_fit": compose(
            """SELECT term, df, n AS n_docs, round(a, 6) AS avg_len, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf
 FROM sparse_df, sparse_totals""",
            "sparse_df",
            "sparse_totals",
        ),
        "bm25_encode": compose(
            """SELECT doc_id, term, round(tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a)), 6) AS weight
 FROM sparse_tf, sparse_totals""",
            "sparse_tf",
            "sparse_totals",
        ),
        "batch_collect": compose(
            "SELECT batch_id, string_agg(text, chr(10)||'--'||chr(10) ORDER BY pos) AS texts FROM batched GROUP BY batch_id", "batched"
        ),
        "extension_share": compose(
            f"""SELECT run_id, ext, n, round(n / sum(n) OVER (PARTITION BY run_id), 6) AS share FROM (SELECT run_id,
 lower({raw_ext('file_path')}) AS ext, count(*) AS n FROM (SELECT 'sparse' AS run_id, doc_id FROM sparse UNION ALL
 SELECT 'dense', doc_id FROM dense) JOIN files_v USING (doc_id) GROUP BY ALL)""",
            "sparse",
            "dense",
            "files_v",
        ),
        "compare_runs": compose(
            """SELECT r.run_id, metric, round(avg(r.value), 6) AS mean, round(avg(r.value - b.value), 6) AS difference,
 CAST(sum(CASE WHEN r.value - b.value > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
 CAST(sum(CASE WHEN r.value - b.value < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS losses
 FROM run_values r LEFT JOIN run_values b USING (query_id, metric) WHERE b.run_id = 'sparse' GROUP BY r.run_id, metric""",
            "run_values",
        ),
        # G
        "assign_batches": compose("SELECT chunk_id, batch_id, batch_no, pos FROM batched", "batched"),
        "token_budget_batches": compose(
            "SELECT chunk_id, namespace||'/'||no AS batch_id, pos FROM budget_packed", "budget_packed"
        ),
        "rate_windows": compose(
            f"""SELECT batch_id, n_tokens, tokens_so_far, requests_so_far,
 CASE WHEN large THEN small_before // 120000 + 2 * large_before + 1 ELSE small_before // 120000 + 2 * large_before END AS minute FROM (
 SELECT batch_id, n_tokens, large, CAST(sum(n_tokens) OVER w AS BIGINT) AS tokens_so_far, count(*) OVER w AS requests_so_far,
 CAST(sum(CASE WHEN large THEN 0 ELSE cost END) OVER w AS BIGINT) - CASE WHEN large THEN 0 ELSE cost END AS small_before,
 CAST(sum(large::INT) OVER w AS BIGINT) - large::INT AS large_before
 FROM (SELECT *, cost > 120000 AS large FROM (SELECT *, greatest(n_tokens * 12, 20000) AS cost FROM (
 SELECT namespace, batch_no, batch_id, CAST(sum(num_tokens) AS BIGINT) AS n_tokens FROM batched GROUP BY ALL)))
 WINDOW w AS (ORDER BY batch_no // 1024, {bucket('namespace', 4096)}, namespace, batch_no ROWS UNBOUNDED PRECEDING))""",
            "batched",
        ),
        "rank_hits": compose(
            f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
 FROM (SELECT query_id, doc_id, {scored} AS score FROM cosine)""",
            "cosine",
        ),
        "history_context": compose("SELECT conv_id, turn, text, history FROM history WHERE role = 'user'", "history"),
        # H
        "topk_cosine": compose("SELECT query_id, doc_id, score, rank FROM cosine", "cosine"),
        "topk_dot": compose("SELECT query_id, doc_id, score, rank FROM dot", "dot"),
        "topk_l2": compose("SELECT query_id, doc_id, score, rank FROM l2", "l2"),
        "topk_bm25": compose("SELECT query_id, doc_id, score, rank FROM sparse", "sparse"),
        "rerank_topn": compose("SELECT query_id, doc_id, score, rank FROM reranked", "reranked"),
        "limit_instances": "SELECT item_id AS query_id, text AS question FROM benchmark ORDER BY item_id LIMIT 10",
        # I
        "multi_query_union": compose(
            """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT
 split_part(query_id, '#', 1)::BIGINT AS query_id, doc_id, max(score) AS score FROM variants GROUP BY ALL)""",
            "variants",
        ),
        "union_sources": compose(
            f"""SELECT {CHUNK_ID} AS chunk_id, file_path, NULL AS url, start_pos, NULL AS start_comment, num_tokens FROM chunks
 UNION ALL SELECT chunk_id, NULL, url, NULL, start_comment, num_tokens FROM issue_chunks""",
            "chunks",
            "issue_chunks",
        ),
        "excluded_paths": compose(f"SELECT file_path FROM files_v WHERE NOT ({VISIBLE} AND {include})", "files_v"),
        "dedup_chunks": compose("SELECT file_path, start_pos, end_pos FROM chunks", "chunks"),
        "upsert_index": f"{versions}, (CASE WHEN label >= 5 THEN 2 ELSE 1 END)::BIGINT AS version FROM embeddings",
        "stream_upsert": "SELECT 'acme/v'||(vec_id % 4) AS namespace, vec_id::VARCHAR AS chunk_id, label::BIGINT AS num_tokens FROM embeddings",
        # J
        "embed_chunks": compose(
            """SELECT id AS doc_id, unnest(range(len(v))) AS dim, round(unnest(list_transform(v, lambda x: x::FLOAT))::DOUBLE, 6) AS value FROM doc_vectors""",
            "doc_vectors",
        ),
        "retrieve_dense": compose(
            "SELECT query_id, doc_id, score, rank, label::BIGINT AS label FROM cosine JOIN embeddings ON vec_id = doc_id", "cosine"
        ),
        "retrieve_sparse": compose("SELECT query_id, doc_id, score, rank, lang, source FROM sparse JOIN documents USING (doc_id)", "sparse"),
        "hybrid_rrf": compose("SELECT * FROM rrf", "rrf"),
        "hybrid_weighted": compose("SELECT * FROM weighted", "weighted"),
        "retrieve_by_path": compose("SELECT query_id, doc_id AS file_path, score, rank FROM by_path", "by_path"),
        "rerank_fallback": compose("SELECT query_id, doc_id, score, fell_back, rank FROM fallback", "fallback"),
        "build_index": compose(
            f"""SELECT namespace, {CHUNK_ID} AS chunk_id, num_tokens, text FROM any_chunks WHERE {VISIBLE} AND NOT {exclude}
 UNION ALL SELECT 'acme/chat/issues', chunk_id, num_tokens, text FROM indexed_issue_chunks""",
            "any_chunks",
            "indexed_issue_chunks",
        ),
        # L
        "render_tree": compose("SELECT namespace, node_path, depth, line FROM tree_lines", "tree_lines"),
        "render_tree_methods_only": compose(
            f"""SELECT DISTINCT namespace, node_path, depth, repeat(' ', (4 * depth)::INT)||name AS line FROM
 (SELECT * FROM tree_nodes WHERE need <> 1)""",
            "tree_nodes",
        ),
        "fit_tree": compose("SELECT namespace, variant, n_tokens, outline FROM outlines", "outlines"),
        "standalone_question": compose(
            f"""SELECT conv_id, turn, CASE WHEN history <> '' THEN '{context.REWRITE_INSTRUCTION}'||chr(10)||chr(10)||history
 ||chr(10)||chr(10)||'Last message: '||text ELSE text END AS prompt FROM history WHERE role = 'user'""",
            "history",
        ),
        "rag_prompt": compose(
            f"""SELECT item_id AS query_id, '{context.ANSWER_INSTRUCTION}'||chr(10)||chr(10)||coalesce(p, '')||chr(10)||chr(10)
 ||'Question: '||text AS prompt FROM benchmark LEFT JOIN (SELECT query_id, string_agg(text, chr(10)||chr(10) ORDER BY rank) AS p
 FROM sparse JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id) ON query_id = item_id""",
            "sparse",
        ),
        "picker_prompt": compose(
            f"""SELECT query_id, namespace, '{context.PICKER_INSTRUCTION.format(k=q.K)}'||chr(10)||chr(10)||outline AS system_prompt,
 'Question: '||question AS user_prompt FROM path_questions JOIN outlines USING (namespace)""",
            "path_questions",
            "outlines",
        ),
        # M
        "eval_rprec": _metric("rprec"),
        "eval_p1": _metric("p1"),
        "eval_recall3": _metric("r3"),
        "eval_ndcg3": _metric("ndcg3"),
        "eval_map": _metric("map"),
        "eval_mrr": _metric("mrr"),
        "eval_report": compose("SELECT * FROM bm25_report", "bm25_report"),
    }
    # Scores are ranked as they are and shown with six digits.
    shown = lambda text: f"SELECT * REPLACE (round(score, 6) AS score) FROM ({text})"
    return {name: shown(text) if name in SCORED else text for name, text in sql.items()}
