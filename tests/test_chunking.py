"""Chunkers: limits, offsets, and that no visible character is lost."""

import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.tokens import TOKEN, count_tokens, pieces, term_counts, terms, truncate_tokens
from shelfmark.operators import chunking, issues as issue_ops, symbols
from shelfmark.plans import views

MAX = 100


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, content string")


def check(rows, contents, limit, tokens):
    last = {}
    covered = {path: set() for path in contents}
    for r in sorted(rows, key=lambda r: (r.file_path, r.start_pos)):
        content = contents[r.file_path]
        body = content[r.start_pos : r.end_pos]
        assert r.text == f"{r.file_path}\n\n{body}"
        assert body == body.strip(" \t\n\r\f\x0b") != ""
        assert r.start_pos >= last.get(r.file_path, 0)
        last[r.file_path] = r.end_pos
        assert tokens[r.text] == r.num_tokens <= limit
        covered[r.file_path].update(range(r.start_pos, r.end_pos))
    for path, content in contents.items():
        lost = [c for i, c in enumerate(content) if i not in covered[path] and not c.isspace()]
        assert not lost, path


def token_counts(spark, rows):
    texts = spark.createDataFrame([(r.text,) for r in rows], "text string").distinct()
    return {r.text: r.n for r in texts.select("text", count_tokens(F.col("text")).alias("n")).collect()}


@pytest.mark.parametrize("chunker", [chunking.chunk_text, chunking.chunk_code, chunking.chunk_any])
def test_invariants_on_documents(spark, sf_dir, chunker):
    docs = views.files_v(spark, sf_dir).select("file_path", "content")
    rows = chunker(docs, MAX).collect()
    check(rows, {r.file_path: r.content for r in docs.collect()}, MAX, token_counts(spark, rows))


def test_text_is_packed_greedily(spark):
    content = "".join(f"word{i} is here\n" for i in range(40))
    rows = chunking.chunk_text(files(spark, [("a/b/c.txt", content)]), 37).orderBy("start_pos").collect()
    # 7 tokens for the path leave 30, ten lines of three tokens each.
    assert [r.num_tokens for r in rows] == [37, 37, 37, 37]


def test_long_line_is_cut_after_sentences_then_by_tokens(spark):
    content = "One two three. Four five six! " + " ".join(f"w{i}" for i in range(50))
    rows = chunking.chunk_text(files(spark, [("f", content)]), 11).orderBy("start_pos").collect()
    assert rows[0].text == "f\n\nOne two three. Four five six!"
    assert [r.num_tokens for r in rows[1:]] == [11, 11, 11, 11, 11]


def test_blank_files_give_nothing(spark):
    rows = [("a.py", " \n\t\n"), ("b.txt", ""), ("c.ipynb", '{"cells": []}')]
    assert chunking.chunk_any(files(spark, rows), MAX).count() == 0


def test_path_must_leave_room(spark):
    with pytest.raises(Exception, match="leaves no room"):
        chunking.chunk_text(files(spark, [("a/b/c/d/e.txt", "x")]), 5).collect()


def test_code_is_cut_at_blocks(spark):
    body = "".join(f"    x{i} = {i}\n" for i in range(12))
    content = "".join(f"def f{n}():\n{body}\n" for n in range(4))
    rows = chunking.chunk_code(files(spark, [("m.py", content)]), 60).orderBy("start_pos").collect()
    assert [content[r.start_pos :].split("(")[0] for r in rows] == ["def f0", "def f1", "def f2", "def f3"]


def test_small_neighbours_are_merged(spark):
    content = "".join(f"a{i} = {i}\n" for i in range(60))
    rows = chunking.chunk_code(files(spark, [("m.py", content)]), 150).collect()
    # Three tokens a line, three of the path; a merge needs 6 + both < 100.
    assert max(r.num_tokens for r in rows) == 3 + 93


def test_merge_of_stored_chunks_equals_merge_in_the_row(spark):
    content = "".join(f"a{i} = {i}\n" for i in range(60))
    whole = chunking.chunk_code(files(spark, [("m.py", content)]), 150).select("start_pos", "end_pos")
    lines = chunking.chunk_text(files(spark, [("m.py", content)]), 6)
    merged = chunking.merge_small_chunks(lines, 150).select("start_pos", "end_pos")
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_notebook_source_shapes(spark):
    cells = [
        {"cell_type": "markdown", "source": "# title"},
        {"cell_type": "code", "source": "x = 1"},
        {"cell_type": "code", "source": ["y = 2\n", "z = 3"]},
    ]
    nb = json.dumps({"cells": cells, "nbformat": 4, "metadata": {}})
    row = chunking.chunk_any(files(spark, [("n.IPYNB", nb)]), MAX).first()
    assert row.text == "n.IPYNB\n\nx = 1\ny = 2\nz = 3" and row.chunker == "notebook"


def test_stored_text_round_trip(spark, sf_dir):
    docs = views.files_v(spark, sf_dir).select("file_path", "content")
    chunks = chunking.chunk_text(docs, MAX)
    rebuilt = chunking.hydrate_text(chunking.drop_stored_text(chunks), docs)
    assert rebuilt.select("chunk_id", "text").exceptAll(chunks.select("chunk_id", "text")).isEmpty()


def test_tokens(spark):
    text = " def  f_1(é):\n\treturn 'x' \n"
    row = spark.createDataFrame([(text,)], "t string").select(
        count_tokens(F.col("t")).alias("n"),
        F.array_join(pieces(F.col("t")), "").alias("all"),
        truncate_tokens(F.col("t"), 4).alias("cut"),
        term_counts(terms(F.lit("b a B c a b"))).alias("tf"),
    ).first()
    assert row.n == len(re.findall(TOKEN.replace(r"\p{L}\p{N}_", r"\w"), text)) == 10
    assert row["all"] == text and row.cut == " def  f_1(é"
    assert [tuple(x) for x in row.tf] == [("a", 2), ("b", 3), ("c", 1)]


def issue(spark, title, body, comments):
    rows = [("u", "h/1", title, body, [{"url": "c", "html_url": "h", "body": c} for c in comments])]
    schema = "url string, html_url string, title string, body string, comments array<struct<url:string,html_url:string,body:string>>"
    return spark.createDataFrame(rows, schema)


def test_issue_text(spark):
    chunk = issue_ops.chunk_issue(issue(spark, "T", "B", []), 100).first()
    assert (chunk.text, chunk.chunk_id) == ("# Issue: T\nB\n\n", "h/1_0_0")
    chunk = issue_ops.chunk_issue(issue(spark, "T", "B", ["one", "two"]), 100).first()
    assert chunk.text == "# Issue: T\nB\n\n## Comment: one\n\n## Comment: two" and chunk.end_comment == 2


def test_issue_is_split_and_trimmed(spark):
    words = lambda n: " ".join(["w"] * n)
    chunks = issue_ops.chunk_issue(issue(spark, "T", words(200), [words(30), words(30), words(90)]), 80)
    rows = chunks.orderBy("start_comment", "end_comment").collect()
    # 59 body tokens are kept; each comment costs its tokens plus 20.
    assert [(r.start_comment, r.end_comment, r.num_tokens) for r in rows] == [
        (0, 0, 63), (0, 1, 38), (1, 2, 38), (2, 3, 98)
    ]
    assert rows[1].text.startswith("# Issue: T\n\n## Comment: w")


PY = '''
class A(Base):
    """doc
class of text
    """
    def f(self):
        def inner():
            pass
        return 1

    async def g(self): pass

    class B:
        def h(self): pass

if x:
    def i(): pass
def j():
    class Hidden:
        pass
'''

TS = """
export class Stack<T> {
  private items: T[] = [];
  push(item: T): void {
    if (item) { this.items.push(item); }
    for (const x of this.items) {
      call(x);
    }
  }
  async pop(): Promise<T> {
    return this.items.pop();
  }
}
function helper(a) {
  return a;
}
abstract class Other extends Stack {
  get size() { return 1; }
}
"""


def test_symbols(spark):
    rows = symbols.extract_symbols(files(spark, [("m.py", PY), ("n.txt", PY), ("s.ts", TS)])).collect()
    found = lambda path: [(r.class_name, r.method_name) for r in rows if r.file_path == path]
    assert found("m.py") == [
        ("A", None), ("A", "f"), ("A", "g"), ("B", None), ("B", "h"), (None, "i"), (None, "j")
    ]
    assert found("n.txt") == []
    assert found("s.ts") == [
        ("Stack", None), ("Stack", "push"), ("Stack", "pop"), ("Other", None), ("Other", "size")
    ]


def test_symbols_of_a_file_with_very_many(spark):
    content = "class C:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(5000))
    rows = symbols.extract_symbols(files(spark, [("big.py", content)])).collect()
    assert [r.method_name for r in rows] == [None] + [f"m{i}" for i in range(5000)]


def test_older_and_broken_notebooks(spark):
    old = {"worksheets": [{"cells": [{"cell_type": "code", "input": "a = 1"}, {"cell_type": "markdown", "source": "x"}]}, {"cells": [{"cell_type": "code", "input": ["b = 2\n", "c = 3"]}]}]}
    rows = [("old.ipynb", json.dumps(old)), ("cut.ipynb", '{"cells": [{"cell_ty'), ("none.ipynb", "[1, 2]"), ("other.ipynb", '{"a": 1}'), ("empty.ipynb", " "), ("null.ipynb", None), ("a.py", "x")]
    df = files(spark, rows)
    code = {r.file_path: r.code for r in df.select("file_path", chunking.notebook_code(F.col("content")).alias("code")).collect()}
    assert code["old.ipynb"] == "a = 1\nb = 2\nc = 3" and code["none.ipynb"] is None
    errors = {r.file_path: r.error for r in chunking.notebook_errors(df).collect()}
    assert set(errors) == {"cut.ipynb", "none.ipynb", "other.ipynb", "empty.ipynb", "null.ipynb"}
    assert errors["other.ipynb"] == "no cells" and errors["empty.ipynb"] == errors["null.ipynb"] == "empty" and errors["none.ipynb"] == "no JSON object"
    assert chunking.chunk_any(df, MAX).count() == 2


def test_symbols_of_other_languages(spark):
    sources = {
        "a.java": """// class Fake {
public class Order1 extends Base {
    private String s = "} class Wrong {"; char c = '{';
    Order1(int x) { this.x = x; }
    public int line_1(int a, List<String> b) throws Exception {
        if (a > 0) { return foo(a); }
        new Runnable() { public void run() { } };
    }
    static class Inner { void f() { } }
}""",
        "a.kt": """open class A(val x: Int) : Base(x) {
    private fun <T> two(b: T) = b
    companion object { fun make(): Int { fun nested() {} } }
}
fun String.ext() { }""",
        "a.go": "type T struct {\n x int\n}\nfunc (o *T) m(a int) int { s := `} func no() {` }\nfunc h[K any]() { }",
        "a.rs": "struct U;\nimpl<'a> Show for U { fn fmt(&'a self, c: char) { let y = '{'; } }\nfn h() { }",
        "a.rb": "# class Fake\nmodule M\n  class O < B\n    def one(a)\n      if a then x end\n      b.each do |x| y end\n    end\n    def self.two; end\n  end\nend\ndef h?\nend",
        "a.sh": "# foo() {\nbuild() {\n  inner() { :; }\n}\nfunction other { echo '}'; }",
        "a.py": 'def f(x="""\nclass B:\n    def no(self): pass\n"""):\n    """\nclass C: pass\n    """\nclass D:\n    # def z(self):\n    def h(self): pass',
        "a.ts": 'class A<T> { // class Q {\n  x = `${"class Z {"}`;\n  get v(): Map<string, T> { return 1; }\n  #p(a = f(1)) { if (a) { b(); } }\n}\nconst c = class extends D { };',
        "Rakefile": "def task_one\nend",
        "a.md": "class A:\n    def f(self): pass",
    }
    rows = symbols.extract_symbols(files(spark, list(sources.items()))).collect()
    found = {path: [(r.class_name, r.method_name) for r in rows if r.file_path == path] for path in sources}
    assert found == {
        "a.java": [("Order1", None), ("Order1", "Order1"), ("Order1", "line_1"), ("Inner", None), ("Inner", "f")],
        "a.kt": [("A", None), ("A", "two"), ("A", "make"), (None, "ext")],
        "a.go": [("T", None), ("T", "m"), (None, "h")],
        "a.rs": [("U", None), ("U", "fmt"), (None, "h")],
        "a.rb": [("O", None), ("O", "one"), ("O", "two"), (None, "h")],
        "a.sh": [(None, "build"), (None, "other")],
        "a.py": [(None, "f"), ("D", None), ("D", "h")],
        "a.ts": [("A", None), ("A", "v"), ("A", "#p")],
        "Rakefile": [(None, "task_one")],
        "a.md": [],
    }


def test_long_strings_and_many_escapes_do_not_overflow(spark):
    content = 'class A {\n  s = "' + '\\\\\\"x' * 50_000 + '";\n  t = `' + "\\`}" * 50_000 + "`;\n  f(" + "a, " * 20_000 + "b) { }\n}\n/*" + "*" * 100_000
    rows = symbols.extract_symbols(files(spark, [("big.js", content)])).collect()
    assert [(r.class_name, r.method_name) for r in rows] == [("A", None), ("A", "f")]


def brute_blocks(tokens, indent, limit):
    """Recursive definition: a block that is too long is its first line and the blocks below it."""
    lines = [i for i, d in enumerate(indent) if d > -2]
    bounds = [*lines, len(tokens)]

    def cut(first, last):  # lines first..last-1
        out, k = [], first
        while k < last:
            end = k + 1
            if indent[lines[k]] >= 0:
                while end < last and (indent[lines[end]] < 0 or indent[lines[end]] > indent[lines[k]]):
                    end += 1
            a, b = bounds[k], bounds[end]
            own = k + 1
            while own < end and indent[lines[own]] < 0:
                own += 1
            if indent[lines[k]] < 0:
                while k < last and indent[lines[k]] < 0:
                    k += 1
                out.append((a, bounds[k]))
                continue
            if sum(tokens[a:b]) <= limit:
                out.append((a, b))
            else:
                head = (a, bounds[own])
                if sum(tokens[slice(*head)]) <= limit:
                    out.append(head)
                else:
                    out += brute_packed(tokens, *head, limit)
                out += cut(own, end)
            k = end
        return out

    return [(0, len(tokens))] if sum(tokens) <= limit else cut(0, len(lines))


def brute_packed(tokens, a, b, limit):
    out, open_ = [], None
    for i in range(a, b):
        if open_ is not None and (tokens[i] == 0 or sum(tokens[open_:i]) + tokens[i] <= limit):
            continue
        if tokens[i] == 0:
            continue
        if open_ is not None:
            out.append((open_, i))
        open_ = i
    return out + ([(open_, b)] if open_ is not None else [])


def test_runs_and_blocks_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 40)
        tokens = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(n)]
        indent = [-1 if t == 0 else rng.choice([0, 2, 4, 6, 8, 10, -2]) for t in tokens]
        indent[0] = max(indent[0], -1)
        for i in range(1, n):  # a blank line has no continuation
            if indent[i] == -2 and indent[i - 1] == -1:
                indent[i] = 4
        limit = rng.choice([9, 12, 25])
        assert list(chunking.packed(np.array(tokens), limit)) == brute_packed(tokens, 0, n, limit)
        drop = lambda runs: [r for r in runs if sum(tokens[slice(*r)])]
        assert drop(chunking.blocks(np.array(tokens), np.array(indent), limit)) == drop(brute_blocks(tokens, indent, limit))


def test_code_is_cut_at_any_depth(spark):
    def nested(depth, at=0):
        head = "    " * at + f"def level_{at}(a, b):\n"
        body = "".join("    " * (at + 1) + f"value_{i} = call(a, b, {i})\n" for i in range(6))
        return head + body + (nested(depth - 1, at + 1) * 2 if depth else "")

    content = nested(5)
    rows = chunking.chunk_code(files(spark, [("deep.py", content)]), 60 + 50).orderBy("start_pos").collect()
    assert "".join(content[r.start_pos : r.end_pos].strip() for r in rows).replace(" ", "").replace("\n", "") == content.replace(" ", "").replace("\n", "")
    starts = [content[r.start_pos :].splitlines()[0].strip() for r in rows]
    # Cuts are in front of a definition, or of a line of a body that is too long by itself, but never inside a line.
    assert all(content[r.start_pos - 1 : r.start_pos] in ("", "\n", " ") for r in rows)
    assert sum(s.startswith("def level_5") for s in starts) >= 8 and max(r.num_tokens for r in rows) <= 110


def test_time_a_line_does_not_grow():
    def seconds(n):
        tokens, indent = np.full(n, 7), np.tile([0, 4, 8, 8, 4, 8, 8], n // 7 + 1)[:n]
        start = time.perf_counter()
        runs = list(chunking.blocks(tokens, indent, 60))
        list(chunking.merged(runs, tokens, 5, 200))
        list(chunking.packed(tokens, 60))
        return (time.perf_counter() - start) / n

    seconds(10_000)
    assert seconds(1_000_000) < 5 * min(seconds(10_000) for _ in range(3))


def test_dedup_keeps_issue_chunks_and_namespaces(spark):
    rows = [
        ("o/r", "a.py_0_5", "a.py", 0, 5),
        ("o/r", "a.py_0_5", "a.py", 0, 5),
        ("o/r/c2", "a.py_0_5", "a.py", 0, 5),
        ("o/r", "issue/1_0_1", None, None, None),
        ("o/r", "issue/1_1_2", None, None, None),
        ("o/r", "issue/1_1_2", None, None, None),
    ]
    chunks = spark.createDataFrame(rows, "namespace string, chunk_id string, file_path string, start_pos int, end_pos int")
    assert chunking.dedup_chunks(chunks).count() == 4


def test_notebooks_and_two_commits_are_rebuilt(spark):
    cells = [{"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "source": "def f():\n    return 1"}]
    nb = json.dumps({"cells": cells})
    rows = [("o/r", "n.ipynb", nb), ("o/r", "a.txt", "first commit"), ("o/r/c2", "a.txt", "other words here")]
    docs = spark.createDataFrame(rows, "namespace string, file_path string, content string")
    chunks = chunking.chunk_any(docs, MAX)
    assert chunks.count() == 3
    rebuilt = chunking.hydrate_text(chunking.drop_stored_text(chunks), docs)
    columns = ["namespace", "chunk_id", "text"]
    assert rebuilt.count() == 3 and rebuilt.select(columns).exceptAll(chunks.select(columns)).isEmpty()


def test_tokens_that_declare_nothing_are_not_searched_for_names(spark):
    body = "package p;\nclass A {\n" + "".join(f"  int m{i}(int a) {{ if (a > 0) {{ call(a); }} ; return {i}; }}\n" for i in range(3)) + "}\n"
    df = files(spark, [("a.java", body), ("b.go", "package b\ntype T struct {\n}\nfunc (t *T) go_on() { ; { } }\nfunc f() { }\n")])
    rows = symbols.extract_symbols(df).collect()
    assert {(r.class_name, r.method_name) for r in rows if r.file_path == "a.java"} == {("A", None), ("A", "m0"), ("A", "m1"), ("A", "m2")}
    assert {(r.class_name, r.method_name) for r in rows if r.file_path == "b.go"} == {("T", None), ("T", "go_on"), (None, "f")}
    plan = symbols.extract_symbols(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_language" in plan  # found once for all syntaxes


def test_symbols_look_up_the_language_once_and_fold_in_two_ways(spark):
    paths = spark.range(40).selectExpr("concat('f', id % 4, '.py') AS file_path", "'class A: pass' AS content").distinct()
    plan = symbols.extract_symbols(paths)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".pyw") == 1  # the table of extensions: no filter below takes it along
    assert plan.count("aggregate(") == 2  # one fold for indentation, one for braces and ends of all languages
    assert symbols.extract_symbols(paths).count() == 4


def test_symbols_of_odd_rows(spark):
    rows = [(None, "class A: pass"), ("a.py", None), ("b.py", ""), ("c.java", None), ("d.java", "int class_ = 1; // interface"), ("e", "class A: pass")]
    rows += [("f.js", "class A {\n  func(b) { class C { d() { } } }\n}\nclass E"), ("f.js", "class A { }"), ("g.rb", "def a\n  class B\n  end\nend\ndef c; end")]
    rows += [("h.rs", 'struct S;\nimpl S { fn f() { { } } fn g(); { fn h() { } } }'), ("i.py", "if a:\n\tclass\tB:\n\t\tasync  def\tc(x): pass\n\tdef d():\n\t\tclass E: pass")]
    found = [tuple(r) for r in symbols.extract_symbols(files(spark, rows).coalesce(1)).collect()]
    of = lambda path: sorted((c or "", m or "") for p, c, m in found if p == path)
    assert {p for p, _, _ in found} == {"f.js", "g.rb", "h.rs", "i.py"}
    assert of("f.js") == [("A", ""), ("A", ""), ("E", ""), ("b", "func")]  # what a receiver looks like is taken for one
    assert of("g.rb") == [("", "a"), ("", "c")]
    assert of("h.rs") == [("S", ""), ("S", "f"), ("S", "g"), ("S", "h")]
    assert of("i.py") == [("", "d"), ("B", ""), ("B", "c")]


def test_files_within_the_limit_are_not_walked_line_by_line(spark, monkeypatch):
    limit = 30
    df = files(spark, [("a.py", "x = 1\n\n\ny = 2\n"), ("b.py", "\n \n"), ("c.py", "def f():\n" + "    a = 1\n" * 30)])
    rows = chunking.chunk_code(df, limit).collect()
    assert [(r.start_pos, r.end_pos) for r in rows if r.file_path == "a.py"] == [(0, 13)]
    assert not [r for r in rows if r.file_path == "b.py"] and len([r for r in rows if r.file_path == "c.py"]) > 3
    monkeypatch.setattr(chunking, "blocks", lambda *_: 1 / 0)
    assert chunking.chunk_code(df.where("file_path <> 'c.py'"), limit).count() == 1
