"""Contexts, prompts, citations, checks and the case log."""

from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions import answers as A
from paperloom.functions.tokens import word_set
from paperloom.models import CitingGenerator, HashEncoder, OverlapReranker
from paperloom.operators import lexical
from paperloom.operators.matching import latest_entries, lookup
from paperloom.plans import qa, reports
from workload.base import (
    ASKED_SQL,
    DIM,
    DOCS_SQL,
    FILINGS_SQL,
    asked,
    bm25_sql,
    document_vectors,
    filings,
    lexical_run,
    quoted,
    register,
    runs_sql,
)


def _hits(t, k=3):
    """Short hit lists with their documents as chunks."""
    chunks = t.raw("documents").select(F.col("doc_id").alias("id"), "text", "source", (F.col("doc_id") % 7).alias("page_num"))
    return lookup(lexical_run(t, k), chunks, "id", "inner").join(asked(t), "query_id")


_HITS_SQL = f"""{bm25_sql(3, DOCS_SQL, ASKED_SQL)},
hits AS (SELECT query_id, id, score, rank, d.text AS text, source, id % 7 AS page_num, b.text AS query
  FROM brun JOIN documents d ON id = doc_id JOIN benchmark b ON query_id = item_id),
ctx AS (SELECT query_id, any_value(query) AS query,
  string_agg('[Source ' || rank || '] (来源: ' || source || ', 第 ' || page_num || ' 页)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1)"""

_PROMPT_SQL = "'" + C.QA_PROMPT.replace("'", "''").replace("{context}", "' || context || '").replace("{question}", "' || query || '") + "'"


@register("context_build", f"WITH {_HITS_SQL} SELECT query_id, context FROM ctx")
def context_build(t):
    return qa.build_context(_hits(t))


@register("prompt_fill", f"WITH {_HITS_SQL} SELECT query_id, {_PROMPT_SQL} AS prompt FROM ctx")
def prompt_fill(t):
    context = qa.build_context(_hits(t)).join(asked(t), "query_id")
    return context.select("query_id", A.prompt(F.col("context"), F.col("query")).alias("prompt"))


_MOCK_SQL = "'" + C.MOCK_ANSWER.replace("{head}", "' || left(text, 100) || '") + "'"


@register("generate_mock", f"SELECT conv_id, turn, {_MOCK_SQL} AS answer FROM conversations WHERE role = 'user'")
def generate_mock(t):
    asked_turns = t.conversations.where("role = 'user'")
    return asked_turns.select("conv_id", "turn", A.mock_answer("text").alias("answer"))


def _cited_answer(t):
    """An answer that cites source 1 or 2, or an id that must not be taken for one of them."""
    mark = F.when(F.col("query_id") % 3 == 0, "[Source 1]").when(F.col("query_id") % 3 == 1, "[Source 2] [Source 3]").otherwise("[Source 12]")
    return asked(t).select("query_id", F.concat("query", F.lit(" "), mark).alias("answer"))


@register(
    "cite_bind",
    f"""WITH {_HITS_SQL} SELECT query_id, rank, id AS chunk_id, source, page_num, left(text, 200) || '...' AS text_preview FROM hits
    WHERE (query_id % 3 = 0 AND rank = 1) OR (query_id % 3 = 1 AND rank IN (2, 3))""",
)
def cite_bind(t):
    hits = _hits(t).withColumnRenamed("id", "chunk_id")
    return qa.bind_sources(_cited_answer(t), hits).drop("bbox")


@register(
    "confidence",
    f"""WITH {_HITS_SQL}, m AS (SELECT query_id, avg(CASE WHEN query_id % 4 = 0 THEN score / 100 WHEN query_id % 4 = 1 THEN coalesce(1.0 / nullif(rank - 1, 0), 1.0 / (60 + rank)) ELSE score END) AS mean FROM hits GROUP BY 1)
    SELECT query_id, round(CASE WHEN query_id % 5 = 4 THEN 0 ELSE least(1, mean) END, 6) AS confidence FROM m""",
)
def confidence(t):
    hits = _hits(t).withColumn("rerank_score", F.when(F.col("rank") > 1, 1.0 / (F.col("rank") - 1)).otherwise(0.0))
    hits = hits.withColumn("rrf_score", 1.0 / (60 + F.col("rank"))).withColumn(
        "score",
        F.when(F.col("query_id") % 4 == 0, F.col("score") / 100).when(F.col("query_id") % 4 == 1, 0.0).otherwise(F.col("score")),
    )
    answer = F.when(F.col("query_id") % 5 == 4, C.REFUSAL_ANSWER).otherwise("ok [Source 1]")
    mean = qa.mean_scores(hits)
    return mean.select("query_id", F.round(A.confidence(answer, F.col("mean_score")), 6).alias("confidence"))


@register(
    "refusal",
    f"""WITH {bm25_sql(3, DOCS_SQL, ASKED_SQL)}, q AS (SELECT item_id AS query_id FROM benchmark),
    kept AS (SELECT * FROM brun WHERE score >= 20)
    SELECT query_id, CASE WHEN count(id) = 0 THEN '{C.REFUSAL_ANSWER}' ELSE 'answered' END AS answer, count(id) AS n_hits FROM q LEFT JOIN kept USING (query_id) GROUP BY 1""",
)
def refusal(t):
    """Questions whose hits all score too low are refused."""
    kept = lexical_run(t, 3).where("score >= 20").groupBy("query_id").agg(F.count("*").alias("n_hits"))
    table = asked(t).select("query_id").join(kept, "query_id", "left")
    answer = F.when(F.col("n_hits").isNull(), C.REFUSAL_ANSWER).otherwise("answered")
    return table.select("query_id", answer.alias("answer"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def _collection(t):
    documents = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source", (F.col("doc_id") % 7).alias("page_num"))
    vectors = document_vectors(t).withColumnRenamed("doc_id", "chunk_id")
    return qa.Collection(documents, lexical.build_index(documents), vectors)


def _wordset(text):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))"


_QA_SQL = f"""{runs_sql(40)},
f AS (SELECT query_id, id, v.rank AS v_rank, b.rank AS b_rank,
  round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf_score
  FROM vrun v FULL OUTER JOIN brun b USING (query_id, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v_rank ASC NULLS LAST, b_rank ASC NULLS LAST) AS rank FROM f),
scored AS (SELECT query_id, id, rrf_score, f.rank AS old, count(*) OVER (PARTITION BY query_id) AS retrieved_count, b.text AS query,
  round(len(list_intersect({_wordset('b.text')}, {_wordset('d.text')})) / (len({_wordset('b.text')}) + 1), 9) AS rerank_score
  FROM fused f JOIN documents d ON id = doc_id JOIN benchmark b ON query_id = item_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM scored) WHERE rank <= 5)"""


@register(
    "answer_questions",
    f"""WITH {_QA_SQL} SELECT query_id, any_value(query) || ' [Source 1]' AS answer, round(least(1, avg(rrf_score)), 6) AS confidence,
      any_value(retrieved_count) AS retrieved_count, count(*) AS reranked_count FROM top GROUP BY query_id""",
)
def answer_questions(t):
    """The whole chain: retrieve, fuse, rerank, prompt, generate, score."""
    answers, _ = qa.answer_questions(
        _collection(t), asked(t), HashEncoder(DIM), OverlapReranker(), CitingGenerator()
    )
    return answers.select(
        "query_id", "answer", F.round("confidence", 6).alias("confidence"), "retrieved_count", "reranked_count"
    )


@register("answer_sources", f"WITH {_QA_SQL} SELECT query_id, rank, id AS chunk_id, source FROM top JOIN documents ON id = doc_id WHERE rank = 1")
def answer_sources(t):
    _, sources = qa.answer_questions(
        _collection(t), asked(t), HashEncoder(DIM), OverlapReranker(), CitingGenerator()
    )
    return sources.select("query_id", "rank", "chunk_id", "source")


# --- checks on generated answers --------------------------------------------------------------

_JUDGED_SQL = f"""{FILINGS_SQL},
ans AS (SELECT chunk_id, text AS context,
  CASE chunk_id % 5 WHEN 0 THEN '营收' || revenue || unit || ' [Source 1]' WHEN 1 THEN '营收' || (chunk_id + 12345) || '.5亿元'
    WHEN 2 THEN repeat(company, 30) || ' 98765' WHEN 3 THEN '根据文档，截至2024年1月2日为' || revenue ELSE repeat('研报', 60) || '2024/1/2' END AS answer FROM filings),
nums AS (SELECT *, list_filter(regexp_extract_all(answer, '[0-9,]+\\.?[0-9]*%?'), lambda n: NOT contains(context, n)) AS bad_n,
  list_filter(regexp_extract_all(answer, '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}'), lambda n: NOT contains(context, n)) AS bad_d,
  contains(answer, '[Source') OR contains(answer, '根据文档') AS cited FROM ans),
points AS (SELECT *, CASE WHEN len(bad_n) > 0 THEN 3 ELSE 0 END + CASE WHEN len(bad_d) > 0 THEN 2 ELSE 0 END
  + CASE WHEN NOT cited AND length(answer) > 100 THEN 3 ELSE 0 END AS tenths FROM nums)"""


def _answers(t):
    n = F.col("chunk_id")
    answer = (
        F.when(n % 5 == 0, F.concat(F.lit("营收"), "revenue", "unit", F.lit(" [Source 1]")))
        .when(n % 5 == 1, F.concat(F.lit("营收"), (n + 12345).cast("string"), F.lit(".5亿元")))
        .when(n % 5 == 2, F.concat(F.repeat("company", 30), F.lit(" 98765")))
        .when(n % 5 == 3, F.concat(F.lit("根据文档，截至2024年1月2日为"), "revenue"))
        .otherwise("研报" * 60 + "2024/1/2")
    )
    return filings(t).select("chunk_id", F.col("text").alias("context"), answer.alias("answer"))


@register(
    "hallucination_score",
    f"""WITH {_JUDGED_SQL} SELECT chunk_id, tenths / 10 AS score, array_to_string(bad_n, ' ') AS numbers, array_to_string(bad_d, ' ') AS dates,
    cited AS has_citation, tenths > 5 AS is_hallucination FROM points""",
)
def hallucination_score(t):
    found = _answers(t).select("chunk_id", A.hallucination("answer", "context").alias("h")).select("chunk_id", "h.*")
    return found.select(
        "chunk_id",
        "score",
        F.array_join("unverified_numbers", " ").alias("numbers"),
        F.array_join("unverified_dates", " ").alias("dates"),
        "has_citation",
        "is_hallucination",
    )


@register(
    "verify_answer",
    f"""WITH {_JUDGED_SQL} SELECT chunk_id, tenths <= 5 AND cited AS trusted,
    CASE WHEN tenths > 5 THEN '{C.VERIFY_HALLUCINATION}' WHEN NOT cited THEN '{C.VERIFY_NO_CITATION}' ELSE '{C.VERIFY_TRUSTED}' END AS reason FROM points""",
)
def verify_answer(t):
    checked = _answers(t).select("chunk_id", A.verify("answer", "context").alias("v"))
    return checked.select("chunk_id", "v.trusted", "v.reason")


@register(
    "hallucination_warning",
    f"WITH {_JUDGED_SQL} SELECT chunk_id, answer || CASE WHEN tenths > 5 THEN '{C.HALLUCINATION_WARNING}' ELSE '' END AS answer FROM points",
)
def hallucination_warning(t):
    found = _answers(t).withColumn("bad", A.hallucination("answer", "context")["is_hallucination"])
    return found.select("chunk_id", A.with_warning(F.col("answer"), F.col("bad")).alias("answer"))


@register(
    "numeric_answer_check",
    f"""WITH {FILINGS_SQL}, p AS (SELECT chunk_id, answer AS expected, CASE chunk_id % 3 WHEN 0 THEN '约' || replace(revenue, ',', '') || '亿元' WHEN 1 THEN '为 ' || revenue || ' ' || unit ELSE '未知 12' END AS actual FROM filings),
    n AS (SELECT chunk_id, list_transform(regexp_extract_all(expected, '[0-9,.]+'), lambda x: replace(x, ',', '')) AS e, list_transform(regexp_extract_all(actual, '[0-9,.]+'), lambda x: replace(x, ',', '')) AS a,
      list_transform(list_filter(regexp_extract_all(expected, '[0-9,.]+\\s*(?:亿元|万元|元|%)?'), lambda x: length(x) > 3), lambda x: replace(replace(x, ',', ''), ' ', '')) AS se,
      list_transform(regexp_extract_all(actual, '[0-9,.]+\\s*(?:亿元|万元|元|%)?'), lambda x: replace(replace(x, ',', ''), ' ', '')) AS sa FROM p)
    SELECT chunk_id, list_has_any(e, a) AS correct, list_has_any(se, sa) AS correct_strict FROM n""",
)
def numeric_answer_check(t):
    n = F.col("chunk_id")
    actual = (
        F.when(n % 3 == 0, F.concat(F.lit("约"), F.replace("revenue", F.lit(","), F.lit("")), F.lit("亿元")))
        .when(n % 3 == 1, F.concat(F.lit("为 "), "revenue", F.lit(" "), "unit"))
        .otherwise("未知 12")
    )
    pairs = filings(t).select("chunk_id", F.col("answer").alias("expected"), actual.alias("actual"))
    return pairs.select(
        "chunk_id", A.same_number("expected", "actual").alias("correct"), A.same_amount("expected", "actual").alias("correct_strict")
    )


# --- conversations ----------------------------------------------------------------------------

_PAIRS_SQL = """pairs AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def turn_pairs(t):
    """User turns with the assistant turn that follows; an equi-join on (conversation, turn)."""
    asked_turns = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked_turns.join(replies, ["conv_id", "turn"])


@register(
    "chat_history",
    """SELECT conv_id, turn, role, '**' || role || '**: ' || text AS message, turn - min(turn) OVER (PARTITION BY conv_id) + 1 AS position FROM conversations""",
)
def chat_history(t):
    """Messages of a session in order, one row each, so a very long session stays spread out."""
    start = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    message = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    return t.conversations.join(start, "conv_id").select(
        "conv_id", "turn", "role", message.alias("message"), (F.col("turn") - F.col("first_turn") + 1).alias("position")
    )


_SETS = f"SELECT conv_id, turn, {_wordset('question')} AS q, {_wordset('answer')} AS a, {_wordset('left(answer, 300)')} AS c1, {_wordset('substr(answer, 301)')} AS c2, {_wordset('question || chr(32) || answer')} AS truth FROM pairs"


@register(
    "rag_metrics",
    f"""WITH {_PAIRS_SQL}, s AS ({_SETS}), j AS (SELECT *, list_distinct(list_concat(c1, c2)) AS c FROM s),
    m AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0 END AS faithfulness, CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) ELSE 0 END AS relevancy,
      CASE WHEN len(q) > 0 THEN (len(list_intersect(q, c1)) / len(q) + len(list_intersect(q, c2)) / len(q)) / 2 ELSE 0 END AS context_precision,
      CASE WHEN len(truth) > 0 THEN len(list_intersect(truth, c)) / len(truth) ELSE 0 END AS context_recall FROM j)
    SELECT count(*) AS n_samples, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM m""",
)
def rag_metrics(t):
    """User turns as questions; the reply in two parts as contexts."""
    parts = F.array(word_set(F.left("answer", F.lit(300))), word_set(F.substring("answer", 301, 2**31 - 1)))
    truth = word_set(F.concat("question", F.lit(" "), "answer"))
    scored = turn_pairs(t).select(A.overlap_metrics(word_set("question"), word_set("answer"), parts, truth).alias("m"))
    names = ["faithfulness", "relevancy", "context_precision", "context_recall"]
    return scored.select("m.*").agg(F.count("*").alias("n_samples"), *[F.round(F.avg(n), 6).alias(n) for n in names])


# --- case log ---------------------------------------------------------------------------------

_TYPE_BY_EVENT = {"error": "empty_recall", "view": "irrelevant_answer", "click": "hallucination", "signup": "high_latency"}
_CASES_SQL = "cases AS (SELECT event_id AS case_id, " + (
    "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_BY_EVENT.items()) + " ELSE 'other' END"
) + " AS case_type, 'q' || user_id AS query FROM events)"


def _cases(t):
    name = F.lit("other")
    for event, case in _TYPE_BY_EVENT.items():
        name = F.when(F.col("event_type") == event, case).otherwise(name)
    return t.events.select(
        F.col("event_id").alias("case_id"), name.alias("case_type"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query")
    )


@register(
    "badcase_report",
    f"WITH {_CASES_SQL} SELECT case_type, count(*) AS n_cases, round(count(*) * 100 / (SELECT count(*) FROM cases), 1) AS share FROM cases GROUP BY 1",
)
def badcase_report(t):
    return reports.badcase_counts(_cases(t))


@register(
    "badcase_examples",
    f"""WITH {_CASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY case_id) AS place FROM cases)
    SELECT case_type, place, case_id, query FROM r WHERE place <= 3 AND case_type IN ({quoted(C.BADCASE_TYPES)})""",
)
def badcase_examples(t):
    return reports.badcase_examples(_cases(t)).select("case_type", "place", "case_id", "query")


@register(
    "badcase_log",
    """WITH a AS (SELECT event_id AS query_id, CASE WHEN event_type <> 'error' THEN value / 100 END AS max_score, event_type = 'click' AND value > 50 AS is_hallucination, value * 30 AS latency_ms FROM events)
    SELECT query_id, unnest(list_filter([CASE WHEN max_score IS NULL THEN 'empty_recall' END, CASE WHEN coalesce(max_score, 0) < 0.3 THEN 'irrelevant_answer' END,
      CASE WHEN is_hallucination THEN 'hallucination' END, CASE WHEN latency_ms > 3000 THEN 'high_latency' END], lambda c: c IS NOT NULL)) AS case_type FROM a""",
)
def badcase_log(t):
    log = t.events.select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("query"),
        F.lit("").alias("answer"),
        F.when(F.col("event_type") != "error", F.col("value") / 100).alias("max_score"),
        ((F.col("event_type") == "click") & (F.col("value") > 50)).alias("is_hallucination"),
        (F.col("value") * 30).alias("latency_ms"),
    )
    return reports.flag_badcases(log).select("query_id", "case_type")


@register(
    "irrelevant_flag",
    f"""WITH {bm25_sql(10, DOCS_SQL, ASKED_SQL)} SELECT item_id AS query_id, round(max(score) / 100, 6) AS max_score, coalesce(max(score) / 100 < 0.3, true) AS irrelevant
    FROM benchmark LEFT JOIN brun ON query_id = item_id GROUP BY 1""",
)
def irrelevant_flag(t):
    best = lexical_run(t, 10).groupBy("query_id").agg((F.max("score") / 100).alias("best"))
    table = asked(t).select("query_id").join(best, "query_id", "left")
    return table.select(
        "query_id",
        F.round("best", 6).alias("max_score"),
        reports.irrelevant(F.col("best")).alias("irrelevant"),
    )


@register(
    "latency_flag",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    last AS (SELECT user_id, max(event_id) AS cached FROM e WHERE value * 30 <= 3000 GROUP BY 1)
    SELECT event_id, k, CASE WHEN cached IS NOT NULL THEN 'cached' ELSE 'badcase' END AS outcome FROM e LEFT JOIN last USING (user_id) WHERE value * 30 > 3000""",
)
def latency_flag(t):
    """Slow requests are served from the cache if the user has a fast entry, and logged otherwise."""
    calls = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("value") * 30).alias("ms"))
    return reports.serve_slow(calls, "user_id", "event_id").select("event_id", "k", "outcome")


@register(
    "cache_latest",
    """WITH r AS (SELECT md5(CAST(user_id AS VARCHAR)) AS key, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, ts FROM events)
    SELECT key, event_id, event_type FROM r WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 1000""",
)
def cache_latest(t):
    log = t.events.select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("key"), "event_id", "event_type", "ts")
    return latest_entries(log, "key", [F.desc("ts"), F.desc("event_id")]).select("key", "event_id", "event_type")
