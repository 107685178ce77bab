"""A quality classifier learned from overlapping heuristic labellers.

Three questions are asked of a document: is it decorated junk, does it repeat itself, and is it
toxic? For each there are several
heuristic labellers, which vote yes, vote no or abstain. How often each is right is not known;
expectation-maximisation estimates it from how votes coincide over all documents. Only the counts
of vote patterns enter, and there are at most ``3 ** labellers`` of them, so they fit the driver
whatever the size of the corpus. The posterior of a document's pattern then is the label, with its
probability as weight, on which a logistic scorer over hashed features is trained.

The toxic labellers need words to look for. These are learned from labelled rows (``labels``):
words of which most occurrences, each context counted once, stand in documents marked as toxic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import lowered, slices

#: Bound of the labelled rows that cue words are learned from, and of the rows the scorers are trained on (expected numbers).
LABELLED_ROWS = 10_000
TRAINING_ROWS = 8_000
#: A cue word stands in at least so many contexts in toxic rows, which are at least this share of all its contexts.
CUE_CONTEXTS = 4
CUE_SHARE = 0.8
#: Bound of the list of cue words.
CUES = 1_000
#: Hashed features; each word has two of them, so words that share one are still told apart.
FEATURE_BITS = 18
#: Training rows that are looked at together.
FIT_ROWS = 500
#: Steps of the training at most, the steps that the curvature is estimated from, and the weight of large weights in the loss.
ROUNDS = 60
MEMORY = 8
RIDGE = 3e-5
#: Features that fewer training rows hold stay without weight.
LEAST_ROWS = 15
#: Signals that are features by their bin, and the words needed.
SHAPES = {"symbols": 1, "upper": 1, "distinct": 20, "most": 20, "echo": 5, "decorated": 1, "short": 20, "cues": 1}
#: A word counts by its share of the words, in percent of so many words at least.
PERCENT = 100
LEAST_WORDS = 50
THRESHOLD = 0.5
BATCH_BYTES = 1_000_000

ABSTAIN, YES, NO = 0, 1, 2
#: A-Z in lower case, white space as blanks.
PLAIN = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")), dtype=np.uint8)
#: Classes of bytes: capitals, other letters, symbols, the rest.
CLASSES = 4
CLASS = np.full(256, 3, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:] = 0, 1, 1
CLASS[list(b"#$%&*!|@^~<>{}\\=+_")] = 2


@dataclass
class Labeller:
    """Votes yes at or beyond one limit of a signal, no up to the other; ``least`` words are needed to vote."""

    signal: str
    yes: float
    no: float
    least: int = 1

    def vote(self, signals: dict[str, np.ndarray]) -> np.ndarray:
        x = signals[self.signal] if self.yes > self.no else -signals[self.signal]
        yes, no = (self.yes, self.no) if self.yes > self.no else (-self.yes, -self.no)
        votes = np.where(x >= yes, YES, np.where(x <= no, NO, ABSTAIN))
        return np.where(signals["words"] >= self.least, votes, ABSTAIN)


#: The limits lie where labelled rows are few: of the clean rows of 3 980 labelled ones that have a cue word at all, 99 % have
#: cues for less than 0.006 of their words, of the toxic rows 95 % for more than 0.0139. Each of the three toxic labellers sees a
#: third of the cue words, no two the same one, so that they err independently, as the estimate takes it. The others follow
#: from the shares of symbols, capitals, short and repeated words in rows of either quality in the same way.
LABELLERS = {
    "junk": [
        Labeller("symbols", 0.04, 0.015),
        Labeller("upper", 0.6, 0.3),
        Labeller("decorated", 0.3, 0.1),
        Labeller("short", 0.04, 0.12, 20),
    ],
    "repeats": [
        Labeller("echo", 0.3, 0.05, 5),
        Labeller("distinct", 0.15, 0.3, 20),
        Labeller("most", 0.25, 0.12, 10),
    ],
    "toxic": [
        Labeller("cues0", 0.0035, 0.002),
        Labeller("cues1", 0.0035, 0.002),
        Labeller("cues2", 0.0035, 0.002),
    ],
}
QUESTIONS = list(LABELLERS)
#: Limits of the bins that make features of the signals.
BINS = np.array([0.0005, 0.002, 0.0045, 0.006, 0.007, 0.008, 0.01, 0.015, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8])


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns ``(n, labellers)`` and how often each occurs.

    Returns the probability of yes per pattern, the share of yes, and ``(labellers, 2, 3)`` with the
    probability of each vote given no and yes, among those that vote: who abstains says nothing.
    Starts from majority votes; no rows give no probabilities.
    """
    if not len(patterns):
        return np.zeros(0), 0.0, np.zeros((patterns.shape[1], 2, 3))
    yes, no = (patterns == YES).sum(axis=1), (patterns == NO).sum(axis=1)
    p = np.where(yes + no > 0, (yes + 0.1) / (yes + no + 1.1), 0.05)
    share, given = 0.0, np.ones((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        share = float(np.clip(weight[1].sum() / counts.sum(), 1e-6, 1 - 1e-6))
        for j in range(patterns.shape[1]):
            for v in (YES, NO):
                given[j, :, v] = weight[:, patterns[:, j] == v].sum(axis=1) + 0.5
            given[j, :, [YES, NO]] /= given[j, :, [YES, NO]].sum(axis=0)
        log = np.log([1 - share, share])[:, None] + sum(np.log(given[j][:, patterns[:, j]]) for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, share, given


class Reader:
    """Signals, votes and hashed features of batches of texts."""

    def __init__(self, cues: list[str]):
        self.cues = cues
        self.parts = np.array([xxhash.xxh64_intdigest(w) % 3 for w in cues], dtype=np.int64)

    def read(self, column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """``(signals, number of the text per word, number of the distinct word per word, hashes of the distinct words)``."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        ends = column.buffers()[1]
        ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        counts = np.stack([np.bincount(CLASS[data[a:b]], minlength=CLASSES) for a, b in zip(ends, ends[1:])]).astype(np.float64)
        size = np.maximum(np.diff(ends), 1)
        plain = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(PLAIN[data]))
        split = pc.split_pattern(plain, " ")
        flat = split.flatten().dictionary_encode()
        distinct = flat.dictionary
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        length = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
        real = length[code] > 0  # between two blanks, and in a text without words, is an empty word
        owner, code = owner[real], code[real]
        words = np.bincount(owner, minlength=n)
        total = np.maximum(words, 1)
        pairs, times = np.unique(owner * max(1, len(distinct)) + code, return_counts=True)
        pair_owner = pairs // max(1, len(distinct))
        most = np.zeros(n)
        np.maximum.at(most, pair_owner, times)
        bare = pc.ascii_trim(distinct, characters=".,;:!?\"'()")
        cue = pc.fill_null(pc.index_in(bare, value_set=pa.array(self.cues, pa.large_string())), -1).to_numpy(zero_copy_only=False)
        part = np.where(cue >= 0, self.parts[cue], -1) if len(self.cues) else np.full(len(distinct), -1)
        of = lambda flags: np.bincount(owner, weights=flags.astype(np.float64)[code], minlength=n) / total
        echo = np.zeros(n)
        if len(code):
            again = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
            echo = np.bincount(owner[1:], weights=again, minlength=n) / total
        signals = {
            "words": words,
            "symbols": counts[:, 2] / size,
            "upper": counts[:, 0] / np.maximum(counts[:, :2].sum(axis=1), 1),
            "distinct": np.bincount(pair_owner, minlength=n) / total,
            "most": most / total,
            "echo": echo,
            "decorated": of(pc.match_substring_regex(distinct, r"[#$%&*!|@^~<>{}\\=+_]$").to_numpy(zero_copy_only=False)),
            "short": of(length <= 3),
            "cues": of(part >= 0),
            **{f"cues{k}": of(part == k) for k in range(3)},
        }
        return signals, owner, code, np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)

    def votes(self, signals: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Per question the pattern of votes of each text, as one number to the base of three."""
        out = {}
        for question, labellers in LABELLERS.items():
            pattern = np.zeros(len(signals["words"]), dtype=np.int64)
            for labeller in labellers:
                pattern = pattern * 3 + labeller.vote(signals)
            out[question] = pattern
        return out

    def shapes(self, signals: dict[str, np.ndarray]) -> np.ndarray:
        """``(texts, signals)``: a feature for the bin of each signal, one of its own where there are too few words for it."""
        mask = np.uint64((1 << FEATURE_BITS) - 1)
        out = []
        for name, least in SHAPES.items():
            ids = np.array([xxhash.xxh64_intdigest(f"\0{name}\0{b}") for b in range(len(BINS) + 2)], dtype=np.uint64) & mask
            bins = np.searchsorted(BINS, signals[name], side="right")
            out.append(ids[np.where(signals["words"] >= least, bins, len(BINS) + 1)])
        return np.stack(out, axis=1).astype(np.int64)


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two features of words, from separate bits of their hashes."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def digits(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([pattern // 3 ** (labellers - 1 - j) % 3 for j in range(labellers)], axis=1)


def _share(rows: int, bound: int) -> int:
    """One in how many rows is taken so that about ``bound`` of them are."""
    return max(1, -(-rows // bound))


def learn_cues(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list[str]:
    """Words that mark toxic documents, from a bounded sample of labelled rows.

    Occurrences count once per context, the words next to them, so copies of one text do not make a
    cue of a word that happens to stand in it.
    """
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    share = _share(marked.count(), labelled_rows)
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    # About ``labelled_rows`` rows of a number and a flag: small whatever the size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    clean = F.transform(F.split(lowered(F.col("text")), r"[\s.,;:!?\"'()]+"), lambda w: w)
    rows = stored(sample.select("toxic", clean.alias("w")), "labelled")
    per_row = rows.select("toxic", F.explode_outer(F.array_distinct("w")).alias("word")).groupBy("word")
    counted = per_row.agg(F.count("*").alias("rows"), F.sum(F.col("toxic").cast("int")).alias("bad"))
    likely = counted.where((F.length("word") > 2) & (F.col("bad") >= CUE_CONTEXTS) & (F.col("bad") >= F.col("rows") * CUE_SHARE))
    places = rows.select("toxic", "w", F.posexplode_outer("w").alias("at", "word")).select(
        "toxic", "word", F.xxhash64(F.get("w", F.col("at") - 1), F.get("w", F.col("at") + 1)).alias("context")
    )
    contexts = places.join(likely.select("word"), "word", "left_semi").distinct().groupBy("word").agg(
        F.count("*").alias("all"), F.sum(F.col("toxic").cast("int")).alias("bad")
    )
    chosen = contexts.where((F.col("bad") >= CUE_CONTEXTS) & (F.col("bad") >= F.col("all") * CUE_SHARE))
    return [r["word"] for r in chosen.orderBy(F.desc("bad"), "word").limit(CUES).collect()]


def vote_counts(docs: DataFrame, cues: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per question the patterns of votes over all rows and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cues)
        for batch in slices(batches, "text", BATCH_BYTES):
            signals, *_ = reader.read(batch.column(0))
            for question, pattern in reader.votes(signals).items():
                value, n = np.unique(pattern, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([question] * len(value)), pa.array(value), pa.array(n.astype(np.int64))], ["question", "pattern", "n"]
                )

    found = docs.select("text").mapInArrow(run, "question string, pattern bigint, n bigint")
    rows = found.groupBy("question", "pattern").agg(F.sum("n").alias("n")).orderBy("question", "pattern").collect()
    out = {}
    for question, labellers in LABELLERS.items():
        own = [r for r in rows if r["question"] == question]
        patterns = digits(np.array([r["pattern"] for r in own], dtype=np.int64), len(labellers))
        out[question] = patterns, np.array([r["n"] for r in own], dtype=np.float64)
    return out


@dataclass
class Scorer:
    """Linear weights of the hashed features and the constant, for each question."""

    cues: list[str]
    weights: dict[str, np.ndarray]
    constants: dict[str, float]

    def score(self, reader: Reader, texts: pa.Array) -> dict[str, np.ndarray]:
        signals, owner, code, hashes = reader.read(texts)
        a, b = buckets(hashes)
        shapes = reader.shapes(signals)
        out = {}
        for question, w in self.weights.items():
            of_word = w[a] + w[b]
            mean = PERCENT * np.bincount(owner, weights=of_word[code], minlength=len(texts)) / np.maximum(signals["words"], LEAST_WORDS)
            linear = mean + w[shapes].sum(axis=1) + self.constants[question]
            out[question] = 1 / (1 + np.exp(-np.clip(linear, -500, 500)))
        return out


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Logistic regression with soft labels on one question's training rows."""
    question = rows["question"].iloc[0]
    rows = rows.iloc[np.random.default_rng(0).permutation(np.argsort([hash_row(i) for i in rows["indices"]], kind="stable"))]
    yes = rows["yes"].to_numpy()
    sizes = rows["indices"].str.len().to_numpy()
    place = np.concatenate(rows["indices"].to_numpy()).astype(np.int32, copy=False)
    x = np.concatenate(rows["weights"].to_numpy())
    n = len(rows)
    del rows
    # Some rows at a time, so that what is only needed for a step stays small.
    blocks = [(a, min(a + FIT_ROWS, n)) for a in range(0, n, FIT_ROWS)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    count = np.zeros(1 << FEATURE_BITS, dtype=np.int64)
    for a, b in blocks:
        count += np.bincount(place[ends[a] : ends[b]], minlength=1 << FEATURE_BITS)
    common = (count >= LEAST_ROWS)[place]
    sizes = np.array([np.count_nonzero(common[a:b]) for a, b in zip(ends, ends[1:])], dtype=np.int64)
    place, x = place[common], x[common]
    # Both answers weigh the same in total, if there are any of both.
    balance = np.where(yes > 0.5, 0.5 / max(yes.mean(), 1e-3), 0.5 / max(1 - yes.mean(), 1e-3))
    # Features by their number among those used: through a table, as sorting all of them takes several times their size.
    used = np.flatnonzero(count >= LEAST_ROWS)
    number = np.zeros(1 << FEATURE_BITS, dtype=np.int32)
    number[used] = np.arange(len(used))
    column = number[place]
    del place, common
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = RIDGE / 2 * (w[:-1] @ w[:-1]), np.append(RIDGE * w[:-1], 0.0)
        for a, b in blocks:
            here = slice(ends[a], ends[b])
            owner = np.repeat(np.arange(b - a), sizes[a:b])
            linear = np.bincount(owner, weights=w[column[here]] * x[here], minlength=b - a) + w[-1]
            value += (balance[a:b] * (np.logaddexp(0, linear) - yes[a:b] * linear)).sum() / n
            error = balance[a:b] * (1 / (1 + np.exp(-np.clip(linear, -500, 500))) - yes[a:b]) / n
            gradient[:-1] += np.bincount(column[here], weights=error[owner] * x[here], minlength=len(used))
            gradient[-1] += error.sum()
        return value, gradient

    w = minimum(loss, np.zeros(len(used) + 1))
    constant = float(w[-1])
    used, w = used[w[:-1] != 0], w[:-1][w[:-1] != 0]
    return pd.DataFrame({"question": [question], "constant": [constant], "place": [used.tolist()], "weight": [w.tolist()]})


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """Minimise a smooth convex function by quasi-Newton steps with a short memory and step halving."""
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, gradient = loss(w)
    for _ in range(ROUNDS):
        direction, used = -gradient, []
        for s, y, r in reversed(steps):
            used.append(r * (s @ direction))
            direction = direction - used[-1] * y
        if steps:
            s, y, r = steps[-1]
            direction = direction / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(used)):
            direction = direction + (a - r * (y @ direction)) * s
        size, slope = 1.0 if steps else 1.0 / max(1e-12, np.abs(gradient).sum()), gradient @ direction
        for _ in range(30):
            new = w + size * direction
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - w, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-MEMORY:]
        done = value - new_value < 1e-7 * max(1e-3, abs(value))
        w, value, gradient = new, new_value, new_gradient
        if done:
            break
    return w


def hash_row(indices: np.ndarray) -> int:
    """For an order of rows that does not depend on how they were dealt to tasks."""
    return xxhash.xxh64_intdigest(np.asarray(indices, dtype=np.int32).tobytes()) >> 1


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, training_rows: int = TRAINING_ROWS) -> Scorer:
    """Learn cue words, the labellers' accuracies over all rows, and a scorer for each question."""
    cues = learn_cues(docs, labels, labelled_rows)
    counted = vote_counts(docs, cues)
    total = int(max([0, *(n.sum() for _, n in counted.values())]))
    probability: dict[str, dict[int, float]] = {}
    for question, (patterns, n) in counted.items():
        p, _, _ = posterior(patterns, n)
        number = (patterns * 3 ** np.arange(patterns.shape[1])[::-1]).sum(axis=1) if len(patterns) else []
        probability[question] = dict(zip(np.asarray(number).tolist(), p.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cues)
        for batch in slices(batches, "text", BATCH_BYTES):
            signals, owner, code, hashes = reader.read(batch.column(0))
            a, b = buckets(hashes)
            shapes = reader.shapes(signals)
            votes = reader.votes(signals)
            ends = np.cumsum(signals["words"])
            indices, values = [], []
            for i in range(batch.num_rows):
                own = code[ends[i] - signals["words"][i] : ends[i]]
                places = np.concatenate([a[own], b[own], shapes[i]])
                x = np.concatenate([np.full(2 * len(own), PERCENT / max(LEAST_WORDS, len(own))), np.ones(shapes.shape[1])])
                place, at = np.unique(places, return_inverse=True)
                indices.append(place.tolist())
                values.append(np.bincount(at, weights=x).tolist())
            columns = [pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            columns += [pa.array([probability[q].get(v, 0.0) for v in votes[q].tolist()], pa.float64()) for q in QUESTIONS]
            yield pa.RecordBatch.from_arrays(columns, ["indices", "weights", *QUESTIONS])

    taken = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(_share(total, training_rows))) == 0).select("text")
    schema = "indices array<int>, weights array<double>, " + ", ".join(f"{q} double" for q in QUESTIONS)
    rows = stored(taken.mapInArrow(run, schema), "training")
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).alias("yes")) for q in QUESTIONS]))
    each = rows.select("indices", "weights", asked.alias("_")).select("_.question", "indices", "weights", "_.yes")
    # One group per question, bounded by ``training_rows``.
    fitted = each.groupBy("question").applyInPandas(fit, "question string, constant double, place array<int>, weight array<double>")
    weights = {q: np.zeros(1 << FEATURE_BITS) for q in QUESTIONS}
    constants = dict.fromkeys(QUESTIONS, -20.0)
    for r in fitted.collect():
        weights[r["question"]][r["place"]] = r["weight"]
        constants[r["question"]] = r["constant"]
    return Scorer(cues, weights, constants)


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``docs``, and one more at the end for the probability of each question, under names that ``docs`` does not have."""
    # 2**FEATURE_BITS numbers per question and at most CUES words; plain values, as workers need not know this module.
    sent = docs.sparkSession.sparkContext.broadcast((scorer.cues, scorer.weights, scorer.constants))
    names = docs.columns
    at = names.index("text")
    mark = "_quality_"
    while any(f"{mark}{q}" in names for q in QUESTIONS):
        mark = f"_{mark}"
    added = [f"{mark}{q}" for q in QUESTIONS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*sent.value)
        reader = Reader(own.cues)
        for batch in slices(batches, "text", BATCH_BYTES):
            found = own.score(reader, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[q]) for q in QUESTIONS)], [*names, *added]
            )

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, junk, repeats, toxic, keep)`` for every row of ``docs(doc_id, text, …)``.

    The first three are probabilities; a row is kept when all are below ``THRESHOLD``.

    * Null and empty texts have no words; the labellers that need words abstain on them, and the scorer
      judges them by the features of the signals alone.
    * Repeated rows count as often as they occur and get the same result. Rows without ``doc_id`` are scored like others.
    * Without labelled rows there are no cue words and nothing is toxic. Empty tables give an empty result.
    * Other columns are ignored whatever their names.
    """
    own = docs.select("doc_id", "text")
    scored = scores(own, train(own, labels))
    return scored.select(
        "doc_id",
        *[F.col(f"_quality_{q}").alias(q) for q in QUESTIONS],
        (F.greatest(*[f"_quality_{q}" for q in QUESTIONS]) < THRESHOLD).alias("keep"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`classify` does not keep."""
    scored = scores(docs, train(docs.select("doc_id", "text"), labels))
    kept = scored.where(F.greatest(*[F.col(c) for c in scored.columns[-len(QUESTIONS) :]]) < THRESHOLD)
    return kept.drop(*scored.columns[-len(QUESTIONS) :])
