"""Small inputs with values worked out by hand."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.functions import layout as L
from paperloom.functions import quality as Q
from paperloom.functions import questions as R
from paperloom.functions import tables as T
from paperloom.functions.documents import full_text, full_text_with_tables
from paperloom.functions.tokens import segment_cjk, tokenize, word_set
from paperloom.operators import evaluation as E
from paperloom.operators import fusion, lexical
from paperloom.operators.rerank import overlap_rerank
from paperloom.plans import reports

DOCS = [(1, "alpha beta alpha"), (2, "beta gamma"), (3, "gamma gamma delta epsilon")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def run(spark, ids, query=0):
    data = [(query, x, float(10 - i), i + 1) for i, x in enumerate(ids)]
    return spark.createDataFrame(data, "query_id bigint, id string, score double, rank bigint")


def box(x0, y0, x1, y1):
    return L.box(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])


@pytest.mark.parametrize(
    "query, scores",
    [
        ("alpha gamma", {1: 1.401185, 3: 0.606456, 2: 0.552945}),
        ("gamma gamma", {3: 1.212913, 2: 1.105891}),
    ],
)
def test_bm25_scores(spark, query, scores):
    docs = spark.createDataFrame(DOCS, "chunk_id bigint, text string")
    asked = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    found = {r["id"]: r["score"] for r in lexical.search_chunks(docs, asked).collect()}
    assert found == pytest.approx(scores, abs=1e-6)
    indexed = lexical.search(lexical.build_index(docs), asked)
    assert {r["id"]: r["score"] for r in indexed.collect()} == found


def test_bm25_statistics(spark):
    index = lexical.build_index(spark.createDataFrame(DOCS, "chunk_id bigint, text string"))
    assert tuple(index.corpus().first()) == (3, 3.0)
    idf = {r["term"]: round(r["idf"], 6) for r in index.idf().collect()}
    assert idf == {"alpha": 0.980829, "delta": 0.980829, "epsilon": 0.980829, "beta": 0.470004, "gamma": 0.470004}


def test_rrf_tie_keeps_vector_hit_first(spark):
    fused = fusion.rrf(run(spark, "ABC"), run(spark, "XYA")).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["A", "X", "B", "Y", "C"]
    assert fused[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)


def test_concat_dedupe(spark):
    merged = fusion.concat_dedupe(run(spark, "ABC"), run(spark, "XYA")).orderBy("rank")
    assert [r["id"] for r in merged.collect()] == ["A", "B", "C", "X", "Y"]


def test_hybrid_falls_through_to_the_only_side(spark):
    none = run(spark, "")
    only = fusion.hybrid(run(spark, "ABC"), none).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in only] == [("A", 10.0), ("B", 9.0), ("C", 8.0)]
    only = fusion.hybrid(none, run(spark, "XY")).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in only] == [("X", 10.0), ("Y", 9.0)]


@pytest.mark.parametrize("company, kept", [("甲乙", 1), ("丙丁", 2)])
def test_company_filter_keeps_all_without_match(spark, company, kept):
    hits = spark.createDataFrame(
        [(0, f"{company}的净利润是多少", "s_甲乙_1.pdf"), (0, f"{company}的净利润是多少", "s_乙甲_2.pdf")],
        "query_id bigint, query string, source string",
    )
    assert fusion.filter_by_company(hits).count() == kept


def test_metrics(spark):
    judged = spark.createDataFrame([(0, "b"), (0, "e"), (0, "z")], "query_id bigint, id string")
    asked = spark.createDataFrame([(0,), (1,)], "query_id bigint")
    found = {r["query_id"]: r for r in E.per_query(run(spark, "abcde"), judged, asked).collect()}
    assert found[0]["recall_5"] == pytest.approx(0.6666667)
    assert found[0]["mrr"] == 0.5
    assert found[0]["ndcg"] == pytest.approx(0.4776237, abs=1e-6)
    assert (found[1]["recall_5"], found[1]["mrr"], found[1]["ndcg"]) == (0.0, 0.0, 0.0)
    empty = E.averages(E.per_query(run(spark, "ab"), judged, asked.limit(0))).first()
    assert empty["n_queries"] == 0 and empty["mrr"] is None


def test_upper_median(spark):
    ranks = spark.createDataFrame([("a", r) for r in (1, 2, 3, 10, None)], "kind string, rank bigint")
    found = E.rank_statistics(ranks, "kind").first()
    assert (found["n_found"], found["median_rank"], found["mean_rank"], found["max_rank"]) == (4, 3, 4.0, 10)


@pytest.mark.parametrize(
    "query, expanded",
    [
        ("公司营收是多少", "公司营收营业收入 收入是多少"),
        ("归母净利润", "归母净利净利润 归母净利润润净利 盈利"),
        ("毛利率和ROE", "毛利率毛利 毛利润率和ROE净资产收益率 股东权益回报率"),
    ],
)
def test_expand_sees_earlier_insertions(spark, query, expanded):
    assert one(spark, R.expand_synonyms(F.lit(query))) == expanded


@pytest.mark.parametrize(
    "query, company, suffix, compat",
    [
        ("在传媒_华录百纳_同花顺_8第3页中，华录百纳的营业收入是多少？", "华录百纳", "同花顺_8", "8"),
        ("格力电器的净利润", "格力电器", "", ""),
        ("今天天气", "", "", ""),
    ],
)
def test_company_and_file(spark, query, company, suffix, compat):
    q = F.lit(query)
    assert one(spark, R.company_in_query(q)) == company
    assert one(spark, R.file_suffix_in_query(q)) == suffix
    assert one(spark, R.file_suffix_in_query(q, compat=True)) == compat


def test_number_tokens(spark):
    tokens = one(spark, tokenize(F.lit("1,711.18亿元 2025年 20.30%")))
    assert [t for t in tokens if t[0].isdigit()] == ["1", "711.18", "2025", "20.30"]
    found = one(spark, A.numbers(F.lit("营收1,711.18亿元，同比30%, ok"), r"[\d,]+\.?\d*%?"))
    assert found == ["1,711.18", "30%", ","]


def test_forward_maximum_match(spark):
    assert one(spark, segment_cjk(F.lit("公司净利润与营业收入增长"))) == ["公", "司", "净利润", "与", "营业收入", "增", "长"]


def test_segmenter_replaces_matching(spark):
    pairs = lambda runs: F.transform(runs, lambda r: F.left(r, F.lit(2)))
    assert one(spark, tokenize(F.lit("Growth 12 研报市场 x"), pairs)) == ["growth", "12", "研报"]


@pytest.mark.parametrize(
    "answer, context, score, flagged",
    [
        ("营收500亿元", "450", 0.3, False),
        ("x" * 101 + "500", "450", 0.6, True),
        ("x" * 101 + "2024/1/2", "2024 1 2", 0.5, False),
    ],
)
def test_hallucination(spark, answer, context, score, flagged):
    found = one(spark, A.hallucination(F.lit(answer), F.lit(context)))
    assert found["score"] == pytest.approx(score)
    assert found["is_hallucination"] is flagged


def test_iou(spark):
    assert one(spark, L.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(0.1428571)
    assert one(spark, L.iou(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0.0


@pytest.mark.parametrize("rank, bound", [(1, False), (2, True), (12, False)])
def test_citation(spark, rank, bound):
    assert one(spark, A.cites(F.lit("see [Source 2]"), F.lit(rank))) is bound


def test_long_citation_does_not_bind_short_rank(spark):
    assert one(spark, A.cites(F.lit("see [Source 12]"), F.lit(1))) is False
    assert one(spark, A.cites(F.lit("see [Source 12]"), F.lit(2))) is False


@pytest.mark.parametrize(
    "answer, mean, expected", [("ok", 0.6, 0.6), ("ok", 7.5, 1.0), ("根据现有研报信息无法回答", 0.6, 0.0), ("ok", None, 0.0)]
)
def test_confidence(spark, answer, mean, expected):
    assert one(spark, A.confidence(F.lit(answer), F.lit(mean).cast("double"))) == expected


def test_overlap_rerank(spark):
    data = [(0, "a b", "a b c", 1), (0, "a b", "a x", 2), (0, "a b", "z", 3)]
    hits = spark.createDataFrame(data, "query_id bigint, query string, text string, rank bigint")
    found = [r["rerank_score"] for r in overlap_rerank(hits).orderBy("rank").collect()]
    assert found == pytest.approx([2 / 3, 1 / 3, 0], abs=1e-9)


@pytest.mark.parametrize("y0, y1, kind", [(2, 14, "header"), (2, 15, "text"), (91, 99, "footer"), (90, 99, "text")])
def test_zones_are_strict(spark, y0, y1, kind):
    assert one(spark, L.block_type(box(0, y0, 5, y1), F.lit("body"), F.lit(100.0))) == kind


@pytest.mark.parametrize("right, kind", [(4, "double_column"), (3, "single_column")])
def test_columns(spark, right, kind):
    boxes = F.array(*[box(0, 0, 10, 1)] * 4, *[box(80, 0, 90, 1)] * right)
    assert one(spark, L.layout_type(boxes, 100.0)) == kind


@pytest.mark.parametrize(
    "text, garbled",
    [("这是一段正常的中文文本。", False), ("看(cid:123)这里", True), ("abc\ue000\ue000", True), ("  ", False)],
)
def test_garbled(spark, text, garbled):
    assert one(spark, Q.is_garbled(F.lit(text), 0.3)) is garbled


def test_table_from_text(spark):
    assert one(spark, T.table_from_text(F.lit("x\na|b\nc|d\ny\ne|f"))) == [["a", "b"], ["c", "d"]]
    assert one(spark, T.table_from_text(F.lit("x\na|b\ny"))) is None
    assert one(spark, T.table_from_text(F.lit("a|b\n||\nc\td\ny"))) == [["a", "b"], ["c", "d"]]


def test_merge_cells(spark):
    data = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("d")))
    assert one(spark, T.merge_cells(data, 0, 0, 0, 1)) == [["a b", ""], ["c", "d"]]


def test_word_set_of_blank_is_empty(spark):
    assert one(spark, word_set(F.lit("  \n"))) == []
    assert one(spark, word_set(F.lit(None).cast("string"))) == []


def test_full_text(spark):
    pages = F.array(F.struct(F.lit(1).alias("page_num"), F.array(F.lit("a"), F.lit("b")).alias("texts")))
    assert one(spark, full_text(pages)) == "\n--- 第 1 页 ---\n\na\nb"
    blocks = F.array(
        F.struct(F.lit("h").alias("text"), F.lit("header").alias("block_type")),
        F.struct(F.lit("a").alias("text"), F.lit("text").alias("block_type")),
    )
    tables = F.array(F.struct(F.lit("| x |").alias("markdown")))
    pages = F.array(F.struct(F.lit(2).alias("page_num"), blocks.alias("text_blocks"), tables.alias("tables")))
    assert one(spark, full_text_with_tables(pages)) == "\n--- 第 2 页 ---\na\n\n[表格]\n| x |\n"


def test_overlap_metrics_recall_is_null_without_truth(spark):
    q, a = word_set(F.lit("a b")), word_set(F.lit("a c"))
    contexts = F.array(word_set(F.lit("a")), word_set(F.lit("c d")))
    found = one(spark, A.overlap_metrics(q, a, contexts, F.lit(None).cast("array<string>")))
    assert (found["faithfulness"], found["relevancy"], found["context_precision"]) == (1.0, 0.5, 0.25)
    assert found["context_recall"] is None


def test_badcase_report_text(spark):
    cases = spark.createDataFrame(
        [(i, "hallucination" if i else "empty_recall", f"q{i}") for i in range(6)],
        "case_id bigint, case_type string, query string",
    )
    text = reports.badcase_report(cases)
    assert "| hallucination | 5 | 83.3 |" in text
    assert text.count("**hallucination**") == 3


def test_weights_change_the_order(spark):
    fused = fusion.rrf(run(spark, "A"), run(spark, "B"), vector_weight=0.1, lexical_weight=1.0)
    assert rows(fused.select("rank", "id")) == [(1, "B"), (2, "A")]
