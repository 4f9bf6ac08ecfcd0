"""Search paths that must agree with each other and with brute force."""

import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from paperloom.models import FunctionEncoder, FunctionGenerator, FunctionReranker, HashEncoder, encode_missing, encode_table
from paperloom.operators import lexical
from paperloom.operators import matching as M
from paperloom.operators.dense import assign_lists, dense_topk, unusable_vectors, mean_vectors, probed_topk, search_by_kind, train_lists
from paperloom.operators.ranking import keep_first
from paperloom.session import fits_broadcast


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)]
    return spark.createDataFrame(data, "chunk_id bigint, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(23)]
    return spark.createDataFrame(data, "query_id bigint, embedding array<double>")


def brute(vectors, questions, k, high=False):
    def unit(v):
        v = np.array(v)
        return v / (np.linalg.norm(v) or 1)

    stored = [(r["chunk_id"], unit(r["embedding"])) for r in vectors.collect()]
    out = []
    for q in questions.collect():
        scored = [(round(float(unit(q["embedding"]) @ v), 6), i) for i, v in stored]
        scored.sort(key=lambda s: (-s[0], -s[1] if high else s[1]))
        out += [(q["query_id"], i, n + 1) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("high", [False, True])
@pytest.mark.parametrize("limits", [{}, {"max_queries": 5, "block_rows": 70}])
def test_dense_equals_brute_force_on_both_paths(vectors, questions, high, limits):
    run = dense_topk(vectors, questions, 7, high_id_first=high, **limits)
    found = sorted((r["query_id"], r["id"], r["rank"]) for r in run.collect())
    assert found == brute(vectors, questions, 7, high)


def test_dense_with_text_ids(vectors, questions):
    named = vectors.withColumn("chunk_id", F.format_string("c%03d", "chunk_id"))
    a = dense_topk(named, questions, 5)
    b = dense_topk(named, questions, 5, max_queries=4, block_rows=100)
    assert rows(a) == rows(b)


def test_dense_with_few_vectors_and_no_queries(vectors, questions):
    assert dense_topk(vectors.limit(3), questions, 10).count() == 3 * 23
    assert dense_topk(vectors, questions.limit(0), 10).count() == 0


def test_probing_every_list_is_exact(spark, vectors, questions):
    centroids = train_lists(vectors, 4)
    stored = assign_lists(vectors, centroids)
    whole = probed_topk(stored, questions, centroids, 6, 4)
    assert rows(whole) == rows(dense_topk(vectors, questions, 6))
    grid = probed_topk(stored, questions, centroids, 6, 2, max_queries=5, block_rows=50)
    assert rows(grid) == rows(probed_topk(stored, questions, centroids, 6, 2))
    with pytest.raises(ValueError):
        search_by_kind("hnsw", vectors, questions)


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 5.0])], "k string, embedding array<float>")
    assert rows(mean_vectors(df, "k")) == [("a", [2.0, 3.0]), ("b", [5.0, 5.0])]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    # every document holds the hot word; a third are copies of one text
    texts = ["hot wa wb"] * 40 + ["hot " + " ".join(rng.choice(words, 9)) for _ in range(80)]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string").repartition(6)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "hot"), (1, "wa wb wc"), (2, "none of these")], "query_id bigint, query string")


def test_lexical_paths_agree_under_a_hot_term(spark, corpus, asked, tmp_path):
    direct = rows(lexical.search_chunks(corpus, asked, 12))
    index = lexical.build_index(corpus)
    assert rows(lexical.search(index, asked, 12)) == direct
    assert rows(lexical.search(index, asked, 12, broadcast_bytes=0, salts=7)) == direct
    assert rows(lexical.search_chunks(corpus, asked, 12, broadcast_bytes=0)) == direct
    index.save(str(tmp_path / "index"))
    stored = lexical.search(lexical.LexicalIndex.load(spark, str(tmp_path / "index")), asked, 12)
    assert rows(stored) == direct
    assert "dynamicpruning" in stored._jdf.queryExecution().executedPlan().toString()
    assert len([r for r in direct if r[0] == 0]) == 12


def test_scores_are_summed_by_document_in_bounded_tasks(spark, corpus, asked, monkeypatch):
    """Pairs of queries and documents are not shuffled, and their tasks become more with their number."""
    direct = rows(lexical.search_chunks(corpus, asked, 12))
    monkeypatch.setattr(lexical, "TASK_PAIRS", 12, raising=False)
    monkeypatch.setattr(lexical, "TASK_TOKENS", 90, raising=False)
    monkeypatch.setattr(lexical, "TASK_BYTES", 200, raising=False)
    index = lexical.build_index(corpus)
    for found in (lexical.search_chunks(corpus, asked, 12), lexical.search(index, asked, 12)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
        assert any(int(n) >= 30 for n in re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\)", plan))
        assert rows(found) == direct
    assert index.postings.rdd.getNumPartitions() >= 10


def test_fits_broadcast_measures(spark):
    df = spark.createDataFrame([("x" * 100,)] * 50, "s string")
    assert fits_broadcast(df, 10_000)
    assert not fits_broadcast(df, 5_000)
    assert fits_broadcast(df.limit(0), 0)


def test_keep_first_with_one_hot_key(spark):
    df = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("k"), "id")
    first = keep_first(df, ["k"], [F.desc("id")])
    assert first.count() == 301
    assert first.where("k = 0").first()["id"] == 699


def test_encoders(spark):
    df = spark.createDataFrame([("1", "alpha beta beta"), ("2", ""), ("3", None)], "chunk_id string, text string")
    table = {r["chunk_id"]: r["embedding"] for r in encode_table(df, HashEncoder(16)).collect()}
    assert np.linalg.norm(table["1"]) == pytest.approx(1.0, abs=1e-6)
    assert table["2"] == [0.0] * 16 == table["3"]
    lengths = FunctionEncoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)
    assert {r["chunk_id"]: r["embedding"] for r in encode_table(df, lengths).collect()}["1"] == [15.0, 1.0]
    done = encode_table(df.where("chunk_id = '1'"), lengths)
    assert rows(encode_missing(df, done, lengths).select("chunk_id")) == [("2",), ("3",)]


def test_model_slots(spark):
    df = spark.createDataFrame([("q", "text")], "query string, text string")
    score = FunctionReranker(lambda: lambda q, t: [len(x) for x in t]).score(F.col("query"), F.col("text"))
    assert df.select(score.alias("s")).first()["s"] == 4.0

    def failing():
        def call(prompts):
            raise RuntimeError("down")

        return call

    answer = FunctionGenerator(failing).generate(F.col("text"), F.col("query"))
    assert df.select(answer.alias("a")).first()["a"].endswith("down")


def test_sampling_is_reproducible(spark):
    df = spark.range(500)
    a = rows(M.sample_seeded(df, "id", 20, seed=1))
    assert a == rows(M.sample_seeded(df.repartition(7), "id", 20, seed=1))
    assert a != rows(M.sample_seeded(df, "id", 20, seed=2))
    split = M.split_by_share(df, "id", [("a", 0.5), ("b", 0.5)])
    assert abs(split.where("split = 'a'").count() - 250) < 50


def test_remap_counts_unmatched_and_uses_clauses(spark):
    chunks = spark.createDataFrame(
        [("c1", "x_甲_v_1.pdf", 1, "营收1711.18亿元"), ("c2", "x_甲_v_1.pdf", 1, "行业竞争格局稳定"), ("c3", "x_乙_v_1.pdf", 2, "7")],
        "chunk_id string, source string, page_num int, text string",
    )
    samples = spark.createDataFrame(
        [
            (1, "x_甲_v_1.pdf", "1", "甲", "1,711.18亿元"),
            (2, "x_甲_v_1.pdf", "1", "甲", "短，行业竞争格局稳定"),
            (3, "gone.pdf", "2", "乙", "7"),
            (4, "gone.pdf", "9", "丙", "8"),
        ],
        "query_id bigint, source_file string, page_num string, company string, answer string",
    )
    found = rows(M.remap_truth(samples, chunks), "query_id")
    assert found == [(1, "c1", "file"), (2, "c2", "file"), (3, "c3", "company"), (4, None, None)]


def test_unusable_vectors_are_left_out(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [1.0]), ("e", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id bigint, embedding array<double>")
    found = dense_topk(vectors, asked, 5)
    assert [(r["query_id"], r["id"]) for r in found.orderBy("rank").collect()] == [(1, "a"), (1, "e")]
    assert {(r["id"], r["size"]) for r in unusable_vectors(vectors, 2).collect()} == {("b", None), ("c", 0), ("d", 1)}


def test_lookup_filters_texts_in_place(spark, tmp_path):
    """Beyond the automatic broadcast limit texts are not shuffled for the few ids asked for."""
    texts = spark.range(2000).select(F.col("id"), F.repeat(F.lit("word "), 400).alias("text"))
    texts.write.parquet(str(tmp_path / "texts"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = M.lookup(spark.createDataFrame([(5,), (7,), (9999,)], "id bigint"), spark.read.parquet(str(tmp_path / "texts")), "id")
        assert sorted((r["id"], r["text"] is None) for r in found.collect()) == [(5, False), (7, False), (9999, True)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\], LeftSemi", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_stored_lists_and_buckets_are_pruned(spark, tmp_path, vectors):
    centroids = mean_vectors(vectors.withColumn("list_no", (F.col("chunk_id") % 6).cast("int")), "list_no")
    lists = assign_lists(vectors, centroids)
    lists.write.partitionBy("list_no").parquet(str(tmp_path / "lists"))
    asked = vectors.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "embedding")
    stored = spark.read.parquet(str(tmp_path / "lists"))
    found = probed_topk(stored, asked, centroids, 5, 1)
    assert rows(found) == rows(probed_topk(lists, asked, centroids, 5, 1))
    assert re.search(r"PartitionFilters: \[[^\]]*list_no#\d+ (IN|=)", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("limits", [{}, {"max_queries": 2, "block_rows": 50}])
def test_questions_of_other_sizes_are_left_out(spark, vectors, limits):
    asked = [(1, [1.0, 2.0]), (2, [1.0] * 8), (3, None), (4, [0.5] * 8), (5, []), (6, [2.0, None] * 4)]
    questions = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    wanted = rows(dense_topk(vectors, questions.where("query_id IN (2, 4)"), 3))
    assert rows(dense_topk(vectors, questions, 3, **limits)) == wanted
    assert rows(dense_topk(vectors, questions, 3, dim=8, **limits)) == wanted
    assert dense_topk(vectors, questions, 3, dim=5, **limits).count() == 0
    assert {r["id"] for r in unusable_vectors(questions, 8, "query_id").collect()} == {1, 3, 5}


def test_each_text_is_encoded_once(spark):
    texts = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(20)], "chunk_id bigint, text string")
    encoder = HashEncoder(16)
    stored = texts.repartition(3).select("chunk_id", encoder.encode("text").alias("embedding"))
    found = dense_topk(stored, texts.limit(3).select(F.col("chunk_id").alias("query_id"), encoder.encode("text").alias("embedding")), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1  # questions are encoded before


def test_centroids_in_blocks(spark, vectors):
    rng = np.random.default_rng(8)
    centroids = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(60)], "list_no int, embedding array<double>")
    odd = vectors.unionByName(spark.createDataFrame([(900, [1.0]), (901, None)], "chunk_id bigint, embedding array<double>"))
    one, many = (rows(assign_lists(odd, centroids, block=block).select("chunk_id", "list_no")) for block in (65536, 7))
    assert one == many and dict(one)[900] is None and dict(one)[901] is None and len(one) == 302
    matrix = np.array([r["embedding"] for r in centroids.orderBy("list_no").collect()])
    matrix = matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) == 0, 1, n)
    for r in vectors.collect():
        v = np.array(r["embedding"])
        assert dict(one)[r["chunk_id"]] == int(np.argmax(np.round(matrix @ (v / (np.linalg.norm(v) or 1)), 6)))
