"""The pipeline stage by stage, on the test tables and on difficult rows."""

from rows_llm import DATA, documents, empty, nasty  # noqa: F401

import corpus_pipeline
from paperloom.llm.language import keep_known
from paperloom.session import write_through


def test_stages_keep_the_columns_and_take_effect(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = write_through(stage(spark, docs, DATA), name)
        assert after.columns == documents.columns
        assert after.schema == documents.schema or name == "pii"
        assert after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count()
    pairs = last.select("doc_id", "text").join(docs.select("doc_id", "text"), ["doc_id", "text"])
    assert pairs.count() == docs.count()  # decoded texts are the encoded ones
    ids = {r["doc_id"] for r in last.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}


def test_difficult_rows_pass(spark, nasty, empty):
    for start in (nasty, empty):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = write_through(stage(spark, docs, DATA), name)
        assert docs.count() == (0 if start is empty else 7)


def test_language_stage_decides_by_language_and_share(spark, documents):
    rows = {r["lang"]: r["text"] for r in documents.where("length(text) > 1500").dropDuplicates(["lang"]).collect()}
    half = [rows[k][:600] for k in ("en", "de", "fr", "es")]
    own = [(10000, half[0], None, "s", 1), (10001, "\n".join(half), "en", "s", 1), (10002, "123 456", "en", "s", 1), (10003, half[3], None, "s", 1)]
    docs = documents.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, docs, DATA).collect()}
    assert kept[10000] == "en" and kept[10003] == "es"  # filled
    assert 10001 not in kept and 10002 not in kept  # four languages in equal parts, none at all
    assert len(kept) >= documents.count() - 2
    only = keep_known(docs, languages=["fr"]).collect()
    assert only and {r["lang"] for r in only} == {"fr"}
