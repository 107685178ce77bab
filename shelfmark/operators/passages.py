"""Which documents contain which passages, all passages looked for at once.

The passages make one automaton: a trie of their characters, in which each node also knows the longest
other node that its text ends with. A document is read once, whatever the number of passages, and
nothing of it is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.rows import explode_computed
from ..functions.tokens import terms

#: Passages are sent to the tasks up to so many bytes; their automaton takes about a hundred times that.
PASSAGE_BYTES = 4 << 20


def passage_matches(documents: DataFrame, passages: DataFrame, sent_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """``(query_id, doc_id)`` where ``documents(doc_id, text)`` contain ``passages(query_id, passage)``.

    Passages without characters are in nothing. More than ``sent_bytes`` of them are joined instead.
    """
    passages = passages.where(F.octet_length("passage") > 0)
    size = passages.agg(F.sum(F.octet_length("passage")).alias("n")).first()["n"] or 0
    return _scanned(documents, passages) if size <= sent_bytes else _joined(documents, passages)


def _scanned(documents: DataFrame, passages: DataFrame) -> DataFrame:
    ids: dict[str, list] = {}
    for row in passages.select("query_id", "passage").collect():  # measured above
        ids.setdefault(row["passage"], []).append(row["query_id"])
    sent = documents.sparkSession.sparkContext.broadcast(list(ids.items()))
    doc_kind, query_kind = (d.schema[c].dataType.simpleString() for d, c in ((documents, "doc_id"), (passages, "query_id")))

    id_type = to_arrow_type(passages.schema["query_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ahocorasick.Automaton()
        for number, (passage, _) in enumerate(sent.value):
            trie.add_word(passage, number)
        if len(trie):
            trie.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for number in {n for _, n in trie.iter(text)} if text and len(trie) else ():
                    queries = sent.value[number][1]
                    rows += [i] * len(queries)
                    found += queries
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(found, id_type), batch.column(0).take(pa.array(rows))], ["query_id", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(search, f"query_id {query_kind}, doc_id {doc_kind}")


def _joined(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """By an equi-join: all words of a passage but the first and last are whole words of a document that contains
    it, so its longest inner word is a key; a passage without inner words is keyed by its first
    character. Every candidate is then checked on the whole texts.
    """
    inner = lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))
    longest = F.transform(inner(terms(F.col("passage"))), lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t")))
    keyed = passages.withColumn(
        "key",
        F.coalesce(
            F.array_max(longest)["t"],
            F.concat(F.lit("\u0001"), F.lower(F.substring("passage", 1, 1))),
        ),
    )
    signature = F.array_distinct(terms(F.col("text")))
    if not keyed.filter(F.col("key").startswith("\u0001")).isEmpty():
        letters = F.array_distinct(F.split(F.lower("text"), ""))
        signature = F.concat(signature, F.transform(letters, lambda c: F.concat(F.lit("\u0001"), c)))
    candidates = (
        explode_computed(documents, ["doc_id"], signature, "key")
        .join(keyed.select("query_id", "key"), "key")
        .select("doc_id", "query_id")
    )
    return (
        candidates.join(documents, "doc_id")
        .join(passages, "query_id")
        .filter(F.col("text").contains(F.col("passage")))
        .select("query_id", "doc_id")
    )
