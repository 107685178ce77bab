"""The pipeline on the smallest tables, against its operators one by one, and on odd tables."""

import corpus_pipeline
import pytest
from shelfmark.llm import decontaminate, line_dedup, quality, sentencepiece_tokens, simhash
from shelfmark.llm.common import table


def test_stages_follow_each_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and 0 < after.count() <= before
    found = corpus_pipeline.run(spark, sf_dir)
    assert 0 < found.count() < before and found.where("not parity").isEmpty()


def test_each_stage_does_what_its_operator_says(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    classes = {r["doc_id"]: r["keep"] for r in quality.classify(docs, table(spark, sf_dir, "labels")).collect()}
    kept = {r["doc_id"]: r for r in corpus_pipeline.classified(spark, docs, sf_dir).collect()}
    assert set(kept) == {d for d, keep in classes.items() if keep} and 0 < len(kept) < len(classes)

    rows = spark.createDataFrame(list(kept.values()), docs.schema)
    removed = {r["doc_id"]: {int(x) for x in r["removed"].split(",") if x} for r in line_dedup.line_report(rows).collect()}
    cut = {r["doc_id"]: r for r in corpus_pipeline.without_repeated_lines(spark, rows, sf_dir).collect()}
    assert {d: r["text"] for d, r in cut.items()} == {
        d: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in removed[d]) for d, r in kept.items()
    }

    rows = spark.createDataFrame(list(cut.values()), docs.schema)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    single = {r["doc_id"]: r for r in corpus_pipeline.without_near_duplicates(spark, rows, sf_dir).collect()}
    assert sorted(groups[d] for d in single) == sorted(set(groups.values()))

    rows = spark.createDataFrame(list(single.values()), docs.schema)
    judged = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(rows, table(spark, sf_dir, "benchmark")).collect()}
    clean = {r["doc_id"]: r for r in corpus_pipeline.decontaminated(spark, rows, sf_dir).collect()}
    assert set(clean) == {d for d, bad in judged.items() if not bad}

    rows = spark.createDataFrame(list(clean.values()), docs.schema)
    own = sentencepiece_tokens.Codec(sentencepiece_tokens.read_model())
    for r in corpus_pipeline.tokenised(spark, rows, sf_dir).collect():
        assert r["ids"] == own.reference.encode(clean[r["doc_id"]]["text"])


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    text = "Several words that are quite plain. " * 8
    rows = [] if empty else [(1, text), (1, text), (2, None), (3, ""), (None, text + "more"), (4, "x" * 300_000), (5, "\n\n \t"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, "a b"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) <= len(rows) and (empty or {1, 2, 3, 4, 5} >= {r["doc_id"] for r in found if r["doc_id"]})
    assert all(r["parity"] for r in found)
