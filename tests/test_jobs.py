"""Readers, writers, ingestion, the question chain and the command line."""

import json
import os
import sys

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.models import CitingGenerator, FunctionEncoder, HashEncoder, MockGenerator
from paperloom.plans import experiments, ingest, qa, snapshots
from paperloom.session import shared_dir
from paperloom.sources import readers, writers
from paperloom.streaming.ingest import ingest_available, stream_parsed


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LineExtractor:
    """Test extractor: a page per line of the file behind its mark."""

    def pages(self, name, content):
        for number, line in enumerate(content.decode("utf-8", "ignore").split("\n")[1:]):
            block = {"text": line, "bbox": None, "block_type": "text", "type": None, "confidence": 1.0, "source": None}
            yield {"page_num": number + 1, "text_blocks": [block], "tables": []}


@pytest.fixture
def parsed(tmp_path):
    folder = tmp_path / "parsed"
    folder.mkdir()
    block = {"text": "格力电器2025年营业收入1,711.18亿元。" * 8, "bbox": [0, 1, 2, 3], "block_type": "text", "confidence": 1.0}
    doc = {"source": "家电_格力电器_同花顺_1.pdf", "pages": [{"page_num": 1, "text_blocks": [block], "tables": []}]}
    other = {"text": "五粮液实现净利润300亿元，毛利率75%。" * 8, "type": "text"}
    bare = [{"page_num": "2", "text_blocks": [other], "tables": [{"data": [["项目", "金额"]] * 30, "markdown": "", "bbox": None}]}]
    (folder / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    (folder / "白酒_五粮液_同花顺_2.json").write_text(json.dumps(bare, ensure_ascii=False))
    (folder / "H3_x.json").write_text(json.dumps({"source": "H3_x.pdf", "pages": []}))
    (folder / "broken.json").write_text("{not json")
    return str(folder)


def test_read_parsed_variants(spark, parsed):
    pages = readers.read_parsed(spark, parsed)
    assert rows(pages.select("source", "page_num")) == [("家电_格力电器_同花顺_1.pdf", 1), ("白酒_五粮液_同花顺_2", 2)]
    assert {r["t"] for r in pages.select(F.col("text_blocks")[0]["block_type"].alias("t")).collect()} == {"text"}
    assert rows(readers.unreadable_parsed(spark, parsed)) == [("broken.json",)]


def test_chain_from_parsed_files(spark, parsed, tmp_path):
    collection = ingest.run_ingestion(spark, parsed, str(tmp_path / "out"), skip_parsing=True)
    assert collection.chunks.where("chunk_type = 'table'").count() == 1
    asked = spark.createDataFrame(
        [(1, "格力电器的营收是多少"), (2, "zzzz")], "query_id bigint, query string"
    )
    chain = qa.Chain(collection, generator=CitingGenerator())
    answers, sources = chain.run(asked)
    found = {r["query_id"]: r for r in answers.collect()}
    assert found[1]["answer"].endswith("[Source 1]")
    assert 0 < found[1]["confidence"] <= 1
    cited = sources.where("query_id = 1").collect()
    assert [(r["rank"], r["source"]) for r in cited] == [(1, "家电_格力电器_同花顺_1.pdf")]
    assert cited[0]["text_preview"].endswith("...")
    assert qa.Chain(collection).chat("格力电器的营收是多少").startswith("[模拟回复]")


def test_refusal_without_any_hit(spark, parsed, tmp_path):
    collection = ingest.run_ingestion(spark, parsed, str(tmp_path / "out"), skip_parsing=True)
    empty = qa.Collection(collection.chunks, collection.index, collection.vectors.limit(0))
    asked = spark.createDataFrame([(1, "zzzz")], "query_id bigint, query string")
    answers, sources = qa.answer_questions(empty, asked, HashEncoder(), None, MockGenerator())
    row = answers.first()
    assert (row["answer"][:14], row["confidence"], row["reranked_count"]) == ("根据现有研报信息无法回答该问", 0.0, 0)
    assert sources.count() == 0


def test_concat_mode_lists_vector_hits_first(spark, parsed, tmp_path):
    collection = ingest.run_ingestion(spark, parsed, str(tmp_path / "out"), skip_parsing=True)
    asked = spark.createDataFrame([(1, "营业收入")], "query_id bigint, query string")
    hits = qa.retrieve(collection, asked, settings=qa.Settings(mode="concat", top_k=1, rewrite="none"))
    assert hits.count() >= 2
    assert hits.where("rank = 1").first()["side"] == 0


def test_parse_skips_done_files(spark, tmp_path):
    folder = tmp_path / "pdf"
    folder.mkdir()
    body = "%PDF-1.7\n" + "\n".join("营业收入" * 60 for _ in range(60))
    (folder / "a_b_c_1.pdf").write_text(body)
    (folder / "small.pdf").write_text("%PDF tiny")
    (folder / "fake.pdf").write_text("x" * 20000)
    assert rows(readers.list_documents(spark, str(folder)).select("source")) == [("a_b_c_1.pdf",), ("fake.pdf",), ("small.pdf",)]
    out = str(tmp_path / "out")
    ingest.run_ingestion(spark, str(folder), out, LineExtractor())
    assert spark.read.parquet(f"{out}/pages").count() == 60
    assert rows(ingest.read_rejects(spark, out).select("source", "error")) == [("fake.pdf", "no pages"), ("small.pdf", "no pages")]
    (folder / "a_b_c_2.pdf").write_text(body)
    ingest.run_ingestion(spark, str(folder), out, LineExtractor())
    counted = spark.read.parquet(f"{out}/pages").groupBy("source").count()
    assert rows(counted) == [("a_b_c_1.pdf", 60), ("a_b_c_2.pdf", 60)]
    pages = readers.extract_pages(readers.read_documents(spark, str(folder)), LineExtractor(), 2, 5)
    assert rows(pages.where("source = 'a_b_c_1.pdf'").select("page_num")) == [(3,), (4,), (5,)]


def test_writers_round_trip(spark, parsed, tmp_path):
    pages = readers.read_parsed(spark, parsed)
    writers.write_pages(pages, str(tmp_path / "json"))
    writers.write_markdown(pages, str(tmp_path / "md"))
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "md"), recursiveFileLookup=True).collect())
    assert "## 第 1 页" in text and "**表格 1**" in text
    chunks = spark.createDataFrame(
        [("c1", "t", "s", "3", None, "table", None, {"has_table": "True"})],
        "id string, text string, source string, page_num string, bbox array<double>, chunk_type string, parent_id string, metadata map<string,string>",
    )
    writers.write_chunks(chunks, str(tmp_path / "chunks"))
    row = readers.read_chunks(spark, str(tmp_path / "chunks")).first()
    assert (row["chunk_id"], row["page_num"], row["has_table"]) == ("c1", 3, True)
    vectors = spark.createDataFrame([("a", [1.0], 0), ("b", [2.0], 1)], "chunk_id string, embedding array<float>, list_no int")
    writers.write_vectors(vectors, str(tmp_path / "vec"), "list_no")
    writers.append_batch(vectors.drop("list_no"), str(tmp_path / "flat"))
    writers.append_batch(vectors.drop("list_no"), str(tmp_path / "flat"))
    assert readers.read_vectors(spark, str(tmp_path / "flat")).count() == 4
    plan = readers.read_vectors(spark, str(tmp_path / "vec")).where("list_no = 1")
    assert "PartitionFilters: [isnotnull(list_no" in plan._jdf.queryExecution().executedPlan().toString()
    writers.write_csv(vectors.select("chunk_id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_json_files_lose_no_rows(spark, tmp_path):
    """Several rows in several files, next to whole documents."""
    block = F.array(F.struct(F.lit("t").alias("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("text").alias("block_type")))
    pages = spark.range(20).repartition(3).select(F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.col("id").cast("int").alias("page_num"), block.alias("text_blocks"))
    writers.write_pages(pages, str(tmp_path / "pages"))
    (tmp_path / "pages" / "one.json").write_text(json.dumps({"source": "one.pdf", "pages": [{"page_num": n, "text_blocks": []} for n in (1, 2)]}))
    (tmp_path / "pages" / "broken.json").write_text("{")
    back = readers.read_parsed(spark, str(tmp_path / "pages"))
    assert rows(back.select("source", "page_num")) == sorted([(f"s{i % 4}", i) for i in range(20)] + [("one.pdf", 1), ("one.pdf", 2)], key=lambda r: tuple(map(repr, r)))
    assert rows(readers.unreadable_parsed(spark, str(tmp_path / "pages"))) == [("broken.json",)]
    chunks = spark.range(20).repartition(3).select(F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("page_num"), F.lit("text").alias("chunk_type"), (F.col("id") % 2 == 0).alias("has_table"))
    writers.write_chunks(chunks, str(tmp_path / "chunks"))
    back = readers.read_chunks(spark, str(tmp_path / "chunks"))
    assert {(r["chunk_id"], r["has_table"]) for r in back.collect()} == {(str(i), i % 2 == 0) for i in range(20)} and back.count() == 20
    samples = spark.range(20).repartition(3).select(F.col("id").cast("string").alias("query_id"), F.lit("q").alias("query"), F.lit("fact").alias("query_type"), F.array(F.lit("c")).alias("ground_truth_doc_ids"))
    writers.write_eval_set(samples, str(tmp_path / "eval"))
    back, judged = readers.read_eval_set(spark, str(tmp_path / "eval"))
    assert back.count() == judged.count() == 20


class FailingExtractor:
    def pages(self, name, content):
        if name.startswith("bad"):
            raise ValueError("no text layer")
        yield {"page_num": 1, "text_blocks": [], "tables": []}


def test_one_bad_file_is_reported(spark, tmp_path):
    for folder, names in (("x", ["same.pdf", "bad.pdf"]), ("y", ["same.pdf"])):
        (tmp_path / "in" / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / "in" / folder / name).write_text("%PDF")
    source, out = f"{tmp_path}/in/*", str(tmp_path / "out")
    ingest.parse_pending(spark, source, out, FailingExtractor())
    ingest.parse_pending(spark, source, out, FailingExtractor())
    stored = spark.read.parquet(f"{out}/pages")
    assert rows(stored.select("source")) == [("same.pdf",), ("same.pdf",)] and stored.select("path").distinct().count() == 2
    assert rows(ingest.read_rejects(spark, out).select("source", "error")) == [("bad.pdf", "ValueError: no text layer")]


def test_eval_set(spark, tmp_path):
    data = {
        "metadata": {"total_samples": 2},
        "samples": [
            {"query": "a", "query_type": "fact", "ground_truth_chunk_id": "c1, c2,", "page_num": 3},
            {"query": "b", "query_type": "summary", "ground_truth_chunk_id": "", "page_num": "x"},
        ],
    }
    (tmp_path / "set.json").write_text(json.dumps(data))
    samples, judged = readers.read_eval_set(spark, str(tmp_path / "set.json"))
    assert rows(samples.select("query", "page_num")) == [("a", "3"), ("b", "x")]
    assert rows(judged.select("id")) == [("c1",), ("c2",)]
    counts = writers.write_eval_set(samples, str(tmp_path / "out"))
    assert rows(counts) == [("fact", 1), ("summary", 1)]


def test_stream_processes_each_file_once(spark, parsed, tmp_path):
    pages = readers.read_parsed(spark, parsed)
    source, chunks, vectors = (str(tmp_path / n) for n in ("pages", "chunks", "vectors"))

    def run():
        query = ingest_available(stream_parsed(spark, source), chunks, vectors, str(tmp_path / "cp"))
        query.awaitTermination()
        return spark.read.parquet(chunks).count(), spark.read.parquet(vectors).count()

    pages.write.parquet(source)
    first = run()
    assert first[0] == first[1] > 0
    assert run() == first
    pages.withColumn("source", F.lit("new.pdf")).write.mode("append").parquet(source)
    assert run() == (2 * first[0], 2 * first[1])


def test_encoder_factory_runs_in_workers(spark, tmp_path):
    texts = spark.createDataFrame([("1", "abc")], "chunk_id string, text string")
    encoder = FunctionEncoder(lambda: lambda xs: [[float(os.getpid())] for _ in xs])
    pid = texts.select(encoder.encode(F.col("text"))[0].alias("p")).first()["p"]
    assert int(pid) != os.getpid()


def test_grid_minimum_follows_overlap(spark):
    texts = spark.createDataFrame([("ab. " * 700,)], "text string")
    grid = experiments.chunk_grid(texts, [256], [50, 200])
    assert rows(grid.select("overlap", F.col("min_chunk_length") >= F.greatest(F.lit(100), "overlap"))) == [(200, True), (50, True)]
    assert experiments.summarise(grid, "chunk_size").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_command_line(spark, parsed, tmp_path, capsys):
    out = str(tmp_path / "coll")
    cli.main(["ingest", "--input", parsed, "--output", out, "--skip-parsing"])
    cli.main(["query", "--collection", out, "--question", "格力电器的营收是多少"])
    assert "confidence:" in capsys.readouterr().out


def test_json_is_told_apart_by_content(spark, tmp_path):
    """Lines, arrays and indented documents under any name; several values and rests are all seen."""
    folder = tmp_path / "any"
    folder.mkdir()
    page = lambda n: {"source": f"s{n}", "page_num": n, "text_blocks": [{"text": f'a "}} {{" b {n}'}], "tables": []}
    lines = lambda *numbers: "\n".join(json.dumps(page(n)) for n in numbers)
    (folder / "corpus.json").write_text("\n\n" + lines(1, 2, 3, 4, 5) + "\n")
    (folder / "more.jsonl").write_text(lines(6, 7))
    (folder / "part-1.json").write_text(json.dumps({"source": "doc", "pages": [page(8), page(9)]}, indent=2))
    (folder / "array.json").write_text(json.dumps([page(10), page(11)], indent=1))
    (folder / "flat.json").write_text(json.dumps([page(12), page(13)]))
    (folder / "two.json").write_text(json.dumps(page(14), indent=2) + "\n" + json.dumps(page(15), indent=2) + " tail")
    (folder / "close.json").write_text(json.dumps(page(16)) + json.dumps(page(17)) + "\n" + json.dumps(page(18)))
    (folder / "hurt.json").write_text('{"source": "s0", \n' + lines(19, 20))
    (folder / "part-2.json").write_text(lines(21) + '\n{"half": \n' + lines(22))
    (folder / "blank.json").write_text(" \n\n")
    (folder / "mark.json").write_text("﻿" + lines(23), encoding="utf-8")
    for broadcast in (True, False):
        with pytest.MonkeyPatch.context() as patch:
            if not broadcast:
                patch.setattr("paperloom.sources.json_values.fits_broadcast", lambda df: False)
            found = readers.read_parsed(spark, str(folder)).select("source", "page_num", F.col("text_blocks")[0]["text"].alias("t")).collect()
        assert sorted(r["page_num"] for r in found) == list(range(1, 24))
        assert all(r["t"] == f'a "}} {{" b {r["page_num"]}' for r in found)
        assert {r["source"] for r in found if r["page_num"] in (8, 9)} == {"doc"}
    assert rows(readers.unreadable_parsed(spark, str(folder))) == [("hurt.json",), ("part-2.json",), ("two.json",)]
    rests = rows(readers.rejected_values(spark, str(folder)).select("text"))
    assert rests == [("tail",), ('{"half":',), ('{"source": "s0",',)]


def _texts(collection):
    return dict(rows(collection.chunks.select("chunk_id", "text")))


def _same_state(spark, found, wanted):
    """Two collections hold the same chunks, vectors, lengths, postings and frequencies."""
    for pick in (lambda c: c.chunks.select("chunk_id", "text"), lambda c: c.vectors, lambda c: c.index.lengths, lambda c: c.index.terms, lambda c: c.index.postings.select("term", "id", "tf", "dl")):
        assert rows(pick(found)) == rows(pick(wanted))


def _chunks(spark, data):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in data], "chunk_id string, text string, source string, page_num int")


def test_additions_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    out, plain = str(tmp_path / "c"), str(tmp_path / "plain")
    first = [(f"c{i}", f"apple pear {i} plum") for i in range(5)]
    ingest.append_chunks(_chunks(spark, first), out)
    monkeypatch.setattr(snapshots, "commit", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.append_chunks(_chunks(spark, [(f"d{i}", f"apple fig {i}") for i in range(3)]), out)
    assert set(_texts(ingest.load_collection(spark, out))) == {i for i, _ in first}  # the half-written batch is not there
    monkeypatch.undo()
    more = [(f"d{i}", f"apple fig {i}") for i in range(5)]
    found = ingest.append_chunks(_chunks(spark, more), out)
    assert dict(rows(found.index.terms))["apple"] == 10 and found.index.lengths.count() == found.vectors.count() == 10
    _same_state(spark, found, ingest.append_chunks(_chunks(spark, first + more), plain))
    before = snapshots.latest(spark, out)
    ingest.append_chunks(_chunks(spark, more), out)  # nothing new, no version
    assert snapshots.latest(spark, out) == before
    # a changed text takes the place of the old one in all tables
    changed = first[:4] + [("c4", "cherry pear")] + more
    found = ingest.append_chunks(_chunks(spark, [("c4", "cherry pear"), more[0]]), out)
    assert _texts(found)["c4"] == "cherry pear"
    _same_state(spark, found, ingest.append_chunks(_chunks(spark, changed), str(tmp_path / "again")))
    # an older snapshot is still whole, and a late writer fails
    assert _texts(ingest.load_collection(spark, out, before))["c4"] == first[4][1]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, before, "late", 0)
    # an addition of a name is made once
    ingest.append_chunks(_chunks(spark, [("e", "fig")]), out, mark="m")
    ingest.append_chunks(_chunks(spark, [("f", "fig")]), out, mark="m")
    assert "f" not in _texts(ingest.load_collection(spark, out))


def test_ingestion_touches_new_and_changed_pages_only(spark, tmp_path, monkeypatch):
    page = lambda n, words: {"source": f"s{n}", "page_num": 1, "text_blocks": [{"text": f"{words} {n}. " * 12}], "tables": []}
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(page(n, "first words")) for n in range(4)))
    ingest.run_ingestion(spark, str(folder), out, skip_parsing=True)
    (folder / "b.json").write_text(json.dumps(page(9, "late words")))
    (folder / "a.json").write_text("\n".join(json.dumps(page(n, "other words" if n == 2 else "first words")) for n in range(4)))
    touched = []
    real = ingest.chunk_pages
    monkeypatch.setattr(ingest, "chunk_pages", lambda pages, *a: touched.extend(r["source"] for r in pages.select("source").collect()) or real(pages, *a))
    found = ingest.run_ingestion(spark, str(folder), out, skip_parsing=True)
    assert sorted(touched) == ["s2", "s9"]
    monkeypatch.undo()
    _same_state(spark, found, ingest.run_ingestion(spark, str(folder), str(tmp_path / "fresh"), skip_parsing=True))
    # chunks of other origin can be added to what run_ingestion has built
    found = ingest.append_chunks(_chunks(spark, [("own", "own words")]), out)
    assert found.chunks.where("chunk_id = 'own'").count() == 1 and found.index.lengths.count() == found.chunks.count()
    # other settings build everything anew
    anew = ingest.run_ingestion(spark, str(folder), out, skip_parsing=True, config={"chunker": {"chunk_size": 100, "chunk_overlap": 20, "min_chunk_size": 30}})
    assert anew.chunks.where("chunk_id = 'own'").count() == 0 and snapshots.latest(spark, out).settings["size"] == 100
    _same_state(spark, ingest.run_ingestion(spark, str(folder), out, skip_parsing=True, skip_chunking=True), anew)


def test_filings_are_written_in_bounded_tasks(spark, monkeypatch):
    """More orders make more tasks, with or without a shuffled join."""
    from conftest import DATA

    from workload import base

    tables = base.Tables(spark, DATA)
    few = rows(base.filings(tables))
    monkeypatch.setattr(base, "TASK_FILINGS", 50, raising=False)
    many = base.filings(tables)
    assert many.rdd.getNumPartitions() >= len(few) / 50
    assert rows(many) == few


def test_ingestion_leaves_only_the_collection(spark, tmp_path, monkeypatch):
    """Two ingestions, the second with new and changed pages: what was written on the way is gone, postings are stored in shares."""
    from paperloom.operators import lexical

    def pages(kept):
        rows = [(f"s{i}", 1, [(f"page {i} {'old ' if i % 3 == 1 and kept < 60 else ''}word{i % 7} more", "text")]) for i in range(kept) if kept == 60 or i % 3 < 2]
        return spark.createDataFrame(rows, "source string, page_num int, text_blocks array<struct<text: string, block_type: string>>")

    def ingest_all(out):
        for n, kept in enumerate((50, 60)):
            folder = str(tmp_path / f"{out}-{n}")
            writers.write_pages(pages(kept), folder, compression="gzip")
            found = ingest.run_ingestion(spark, folder, str(tmp_path / out), config={"chunker": {"chunk_size": 1 << 30, "chunk_overlap": 0, "min_chunk_size": 0}}, skip_parsing=True)
        ask = spark.createDataFrame([(1, "page word3 old"), (2, "more 17")], "query_id int, query string")
        index = found.index
        return sorted(map(tuple, found.chunks.select("chunk_id", "text").collect())), sorted(map(tuple, index.postings.select("bucket", "term", "id", "tf", "dl").collect())), sorted(map(tuple, index.terms.collect())), sorted(map(tuple, lexical.search(index, ask, 5).collect()))

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    whole = ingest_all("whole")
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before}
    assert not left & {"tokens", "new-pages", "new-chunks", "terms"}
    assert len(whole[0]) == 60 and len(whole[3]) == 10 and not any("old" in text for _, text in whole[0])
    monkeypatch.setattr(lexical, "SLICE_TOKENS", 20)
    assert ingest_all("shares") == whole
