"""Personal data by patterns, and by a skip-chain conditional random field on top.

Four patterns give certain spans. The field labels the other tokens of a document that hold digits
or an ``@``, or are the local part of a found address. Its nodes are these tokens and the certain spans, its edges join
neighbours (the chain) and tokens that are the same but for case and punctuation, or numbers that
end in the same digits (the skips), each to the next one like it. Groups of digits with blanks
between them are one node where they make up a number. Loopy belief propagation passes labels along
both, so that a number which the patterns know in one place is found in another where it is written
differently.

Potentials are trained piecewise, from counts over all documents in which the certain spans are the
labels, without the tokens like a certain span: how often a token of a shape has a label, and how often labels meet over either kind of
edge. Shapes are hashed to a fixed number of classes, so the counts have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the certain spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# The same matches in time that grows with the text: a run is read from its beginning only.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP_NEXT = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]
#: Labels of a token: none, or one of the kinds.
LABELS = 1 + len(KINDS)

SHAPES = 4096
#: Least characters of a token, without punctuation, that skips join.
SKIP_LEAST = 6
#: Digits at the end that similar numbers share.
SUFFIX = 7
#: Most digits of a number, and most in each of its groups where no certain span tells its extent.
NUMBER_MOST, GROUP_MOST = 19, 5
#: Most groups of a number.
GROUPS = 8
#: A label is given when its probability exceeds this.
SURE = 0.9
ROUNDS = 20
DAMPING = 0.3

_TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|#$%&*]+")
_DIGIT = re.compile(r"[0-9]")
_BARE = re.compile(r"[^0-9a-z@]+")
_GROUP = re.compile(r"[0-9()+-]+")
_BETWEEN = re.compile(r"\)?[\x20\t]{1,2}\(?")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``: behind one, the rest of a run may begin the next; other runs are whole."""
    at = 0
    while found := (EMAIL_HERE.match(text, at) if at else None) or EMAIL_NEXT.search(text, at):
        yield found.span()
        at = found.end()


def small_part(part: str) -> bool:
    """Whether a part of an address is at most 255, however long it is written."""
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The certain spans of a text per kind, as code points, the end exclusive."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = list(emails(text))
    if _DIGIT.search(text):
        if "." in text:
            out[1] = [m.span() for m in IP_NEXT.finditer(text) if all(map(small_part, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[ -]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def shape(token: str) -> int:
    """The class of a token's shape: its runs of letters and digits and the other characters."""
    runs = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 6)}", token))
    return xxhash.xxh64_intdigest(runs[:48]) % SHAPES


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def disproved(token: str) -> list[int]:
    """The labels of which a token has the form but not what their pattern checks."""
    out = []
    if IP.fullmatch(token) and not all(map(small_part, token.split("."))):
        out.append(1 + KINDS.index("ip"))
    digits = _digits(token)
    if 16 <= len(digits) <= 19 and not luhn(digits):
        out.append(1 + KINDS.index("card"))
    return out


def grouped(text: str, tokens: list[tuple[int, int]], endings: set[str]) -> list[tuple[int, int]]:
    """Tokens, of which groups of digits that run over blanks are put together.

    Groups make up a number when their digits are the end of a certain one (``endings``), or else
    when all groups between two other tokens are short and have the digits of a number in all.
    """
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(tokens):
        end = at + 1
        if _GROUP.fullmatch(text, *tokens[at]):
            while end < len(tokens) and _GROUP.fullmatch(text, *tokens[end]) and _BETWEEN.fullmatch(text, tokens[end - 1][1], tokens[end][0]):
                end += 1
        run = tokens[at:end]
        at = end
        digits = [_digits(text[a:b]) for a, b in run]
        i, rest = 0, 0
        while i < len(run):
            sizes = range(min(GROUPS, len(run) - i), 1, -1) if endings else ()
            n = next((n for n in sizes if "".join(digits[i : i + n]) in endings), 0)
            if n:
                out += _whole(text, run[rest:i])
                out.append((run[i][0], run[i + n - 1][1]))
                rest = i + n
            i += n or 1
        out += _whole(text, run[rest:])
    return out


def _whole(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A run of groups as one number where it may be one."""
    if not 1 < len(run) <= GROUPS:
        return run
    number = text[run[0][0] : run[-1][1]]
    short = all(len(g) <= GROUP_MOST for g in re.findall("[0-9]+", number))
    return [(run[0][0], run[-1][1])] if short and SUFFIX <= len(_digits(number)) <= NUMBER_MOST else run


class Graph:
    """The labelled graph of one document."""

    def __init__(self, text: str, base: list[list[tuple[int, int]]]):
        spans = sorted((a, b, k + 1) for k, own in enumerate(base) for a, b in own)
        locals_ = {text[a:b].split("@")[0].lower() for a, b in base[0]}
        locals_ = {w for w in locals_ if len(w) >= SKIP_LEAST}
        nodes: list[tuple[int, int, int]] = []
        for a, b, label in spans:  # of overlapping spans the first
            if not nodes or a >= nodes[-1][1]:
                nodes.append((a, b, label))
        certain, at = list(nodes), 0
        free: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text):
            stripped = m.group().rstrip(".)-").lstrip("(-.")
            if not stripped or not (_DIGIT.search(stripped) or "@" in stripped or stripped.lower() in locals_):
                continue
            a = m.start() + m.group().index(stripped)
            while at < len(certain) and certain[at][1] <= a:
                at += 1
            if at == len(certain) or certain[at][0] >= a + len(stripped):
                free.append((a, a + len(stripped)))
        numbers = [_digits(text[a:b]) for a, b, label in certain if KINDS[label - 1] in ("card", "phone")]
        endings = {d[i:] for d in numbers for i in range(len(d) - SUFFIX + 1)}
        nodes += [(a, b, 0) for a, b in grouped(text, free, endings)]
        nodes.sort()
        self.spans = [(a, b) for a, b, _ in nodes]
        self.shapes = [shape(text[a:b]) for a, b in self.spans]
        self.known = np.array([label for *_, label in nodes], dtype=np.int64)
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1) if not text[nodes[i][1] : nodes[i + 1][0]].strip()]
        self.not_ = [(i, label) for i, (a, b, known) in enumerate(nodes) if not known for label in disproved(text[a:b])]
        last: dict[str, int] = {}
        self.skips = []
        for i, (a, b) in enumerate(self.spans):
            bare = _BARE.sub("", text[a:b].lower())
            key = bare.split("@")[0] if "@" in bare else bare
            if len(key) >= SKIP_LEAST:
                # The same but for its writing, and the same end of a number; often both are one node.
                like = {key, f"…{key[-SUFFIX:]}"} if key.isdigit() and len(key) >= SUFFIX else {key}
                self.skips += sorted({(last[k], i) for k in like if k in last})
                last.update(dict.fromkeys(like, i))


class Counts:
    """Counts that potentials are made of: labels by shape, and pairs of labels over chains and skips."""

    def __init__(self):
        self.shapes = np.zeros((SHAPES, LABELS))
        self.pairs = np.zeros((2, LABELS, LABELS))

    def add(self, graph: Graph) -> None:
        # A token like a certain span has no label that is known, least of all none: it does not count.
        seen = np.ones(len(graph.known), dtype=bool)
        if graph.skips and graph.known.any():
            a, b = np.array(graph.skips).T
            for x, y in ((a, b), (b, a)):
                seen[x[(graph.known[x] == 0) & (graph.known[y] > 0)]] = False
        np.add.at(self.shapes, (np.array(graph.shapes)[seen], graph.known[seen]), 1)
        for kind, edges in enumerate((graph.chain, graph.skips)):
            if edges:
                a, b = np.array(edges).T
                a, b = a[seen[a] & seen[b]], b[seen[a] & seen[b]]
                np.add.at(self.pairs[kind], (graph.known[a], graph.known[b]), 1)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.shapes.ravel(), self.pairs.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Counts:
        own = cls()
        own.shapes = flat[: SHAPES * LABELS].reshape(SHAPES, LABELS)
        own.pairs = flat[SHAPES * LABELS :].reshape(2, LABELS, LABELS)
        return own

    def potentials(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms: of a label's probability given the shape, and of how much more often two labels
        meet over an edge than two tokens drawn from all would have them."""
        prior = self.shapes.sum(axis=0) + 1
        prior = prior / prior.sum()
        nodes = np.log((self.shapes + 2 * prior) / (self.shapes.sum(axis=1, keepdims=True) + 2))
        pairs = self.pairs + np.swapaxes(self.pairs, 1, 2) + 0.5
        pairs = pairs / pairs.sum(axis=(1, 2), keepdims=True)
        return nodes, np.log(pairs) - np.log(prior)[:, None] - np.log(prior)[None, :]


def marginals(graph: Graph, potentials: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``(tokens, labels)``: probabilities by loopy sum-product messages; certain labels are fixed, disproved ones count as none."""
    nodes, pairs = potentials
    unary = nodes[graph.shapes].copy()
    fixed = np.flatnonzero(graph.known)
    unary[fixed] = -50.0
    unary[fixed, graph.known[fixed]] = 0.0
    for i, label in graph.not_:
        unary[i, 0] = np.logaddexp(unary[i, 0], unary[i, label])
        unary[i, label] = -50.0
    edges = [(a, b, 0) for a, b in graph.chain] + [(a, b, 1) for a, b in graph.skips]
    if not edges:
        return _normal(unary)
    a, b, kind = np.array(edges).T
    # Messages in both directions; each one's reverse is half the list away. Potentials are symmetric.
    source, target, kind = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kind, kind])
    reverse = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    messages = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = belief[source] - messages[reverse]
        joint = out[:, :, None] + pairs[kind]
        top = joint.max(axis=1, keepdims=True)
        new = (top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True)))[:, 0]
        new -= new.max(axis=1, keepdims=True)
        new = (1 - DAMPING) * new + DAMPING * messages
        done = np.abs(new - messages).max() < 1e-4
        messages = new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return _normal(belief)


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[list[tuple[int, int]]], potentials: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of tokens that the field labels and the patterns do not have, neighbours of one kind joined.

    Shape, chain and skips count in every document, whether or not a pattern matches in it.
    """
    if "@" not in text and not _DIGIT.search(text):
        return []
    graph = Graph(text, base)
    if not (graph.known == 0).any():
        return []
    p = marginals(graph, potentials)
    out: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero(graph.known == 0).tolist():
        label = int(p[i, 1:].argmax()) + 1
        if p[i, label] <= SURE:
            continue
        a, b = graph.spans[i]
        if out and last == i - 1 and out[-1][0] == label - 1 and not text[out[-1][2] : a].strip():
            out[-1] = (label - 1, out[-1][1], b)
        else:
            out.append((label - 1, a, b))
        last = i
    return out


def train(docs: DataFrame) -> Counts:
    """Counts over all documents; every task sends one row of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counts()
        for batch in batches:
            for scalar in batch.column(0):
                text = scalar.as_py() or ""
                if "@" in text or _DIGIT.search(text):
                    graph = Graph(text, base_spans(text))
                    if graph.spans:
                        own.add(graph)
        flat = own.flat()
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(flat[place])], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(SHAPES * LABELS + 2 * LABELS * LABELS)
    for r in rows:  # at most as many as the array has places
        flat[r["place"]] = r["n"]
    return Counts.of(flat)


def find_personal_data(docs: DataFrame, counts: Counts | None = None) -> DataFrame:
    """``(doc_id, base, added)`` for every row of ``docs(doc_id, text, …)``.

    ``base`` has the certain spans and ``added`` those of the field, as ``(kind, start, end)`` in code
    points with the number of the kind in ``KINDS``, by kind, then start. Potentials are trained on
    all of ``docs`` unless ``counts`` are given.

    * Null counts as empty; empty texts have no spans. Texts are read whole, however long.
    * Equal tokens, and numbers with one end, are joined each to the next one only, so many repeats make at most two edges a token.
    * Repeated rows count as often as they occur and give repeated result rows; a row without
      ``doc_id`` is scanned like others. An empty table gives an empty result; other columns are ignored.
    """
    potentials = (counts or train(docs)).potentials()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, more = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                base = base_spans(text)
                found.append([(k, a, b) for k, own in enumerate(base) for a, b in own])
                more.append(sorted(added_spans(text, base, potentials)))
            spans = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in rows], pa.list_(span)) for rows in (found, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *spans], ["doc_id", "base", "added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:int,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")


def digests(found: DataFrame) -> DataFrame:
    """The result of :func:`find_personal_data` as counts per kind, ``base_sha256`` and ``spans``, by kind, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(
            F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def counted(number, name):
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[counted(k, name) for k, name in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
