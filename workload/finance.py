"""Filings: question rewriting, extraction and ground-truth matching."""

from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions import answers as A
from paperloom.functions import extraction as X
from paperloom.functions import questions as R
from paperloom.operators import matching as M
from paperloom.operators.fusion import filter_by_company
from paperloom.operators.locate import locate_truth
from paperloom.operators.ranking import first_n
from paperloom.operators.rows import each, each_struct
from paperloom.session import write_through
from workload.base import FILINGS_SQL, filings, quoted, register

# --- questions --------------------------------------------------------------------------------


def _fold(mapping, text, second):
    for term, others in mapping.items():
        target = term + " ".join(others[:2]) if second else others[0]
        text = f"replace({text}, '{term}', '{target}')"
    return text


@register("rewrite_expand", f"WITH {FILINGS_SQL} SELECT chunk_id, {_fold(C.REWRITE_SYNONYMS, 'query', True)} AS query FROM filings")
def rewrite_expand(t):
    return filings(t).select("chunk_id", R.expand_synonyms("query").alias("query"))


@register("rewrite_replace", f"WITH {FILINGS_SQL} SELECT chunk_id, {_fold(C.REWRITE_SYNONYMS, 'query', False)} AS query FROM filings")
def rewrite_replace(t):
    return filings(t).select("chunk_id", R.replace_synonyms("query").alias("query"))


_VARIANTS = ", ".join(
    ["query"]
    + [
        f"CASE WHEN contains(query, '{term}') THEN replace(query, '{term}', '{other}') END"
        for term, others in C.RECOVERY_SYNONYMS.items()
        for other in others
    ]
)


@register(
    "rewrite_variants",
    f"""WITH {FILINGS_SQL}, v AS (SELECT chunk_id, unnest([{_VARIANTS}]) AS variant, generate_subscripts([{_VARIANTS}], 1) AS n FROM filings)
    SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY min(n)) AS variant_no, variant FROM v
    WHERE variant IS NOT NULL GROUP BY chunk_id, variant""",
)
def rewrite_variants(t):
    parts = filings(t).select("chunk_id", F.posexplode(R.query_variants("query")).alias("n", "variant"))
    return parts.select("chunk_id", (F.col("n") + 1).cast("bigint").alias("variant_no"), "variant")


@register(
    "query_strip",
    f"""WITH {FILINGS_SQL} SELECT chunk_id, trim(regexp_replace(regexp_replace(query, '^在.+?第\\d+页中，', ''), '（单位：.+?）', '', 'g')) AS query FROM filings""",
)
def query_strip(t):
    return filings(t).select("chunk_id", R.strip_location("query").alias("query"))


@register(
    "company_extract",
    f"""WITH {FILINGS_SQL} SELECT chunk_id,
      CASE WHEN regexp_matches(query, '[一-鿿]{{2,10}}的[营净毛利总研资每加]') THEN regexp_extract(query, '([一-鿿]{{2,10}})的[营净毛利总研资每加]', 1)
        ELSE regexp_extract(query, '在[^，]+中，([一-鿿]{{2,10}})的', 1) END AS company,
      '年报_' || seq AS suffix, CAST(seq AS VARCHAR) AS suffix_compat FROM filings""",
)
def company_extract(t):
    return filings(t).select(
        "chunk_id",
        R.company_in_query("query").alias("company"),
        F.regexp_replace(R.file_suffix_in_query("query"), "^公司[^_]+_", "").alias("suffix"),
        R.file_suffix_in_query("query", compat=True).alias("suffix_compat"),
    )


@register(
    "company_filter",
    f"""WITH {FILINGS_SQL}, hits AS (
      SELECT a.chunk_id AS query_id, a.company, a.seq AS seq, a.doc AS doc, b.source, b.chunk_id AS id FROM filings a JOIN filings b ON b.chunk_id IN (a.chunk_id, a.chunk_id + 1, a.chunk_id + 10)),
    k AS (SELECT *, contains(source, company) AND contains('_' || replace(source, '.pdf', '') || '_', '_' || CASE WHEN starts_with(doc, 'H3_') THEN company || '_' ELSE '' END || '年报_' || seq || '_') AS keep FROM hits),
    h AS (SELECT query_id, bool_or(keep) AS has FROM k GROUP BY 1)
    SELECT query_id, id, source FROM k JOIN h USING (query_id) WHERE keep OR NOT has""",
)
def company_filter(t):
    data = filings(t)
    candidates = data.select(
        F.col("chunk_id").alias("query_id"),
        "query",
        F.explode(F.array(F.col("chunk_id"), F.col("chunk_id") + 1, F.col("chunk_id") + 10)).alias("id"),
    )
    hits = candidates.join(data.select(F.col("chunk_id").alias("id"), "source"), "id")
    return filter_by_company(hits).select("query_id", "id", "source")


@register(
    "question_templates",
    f"""WITH {FILINGS_SQL} SELECT chunk_id, '在' || replace(replace(source, '_年报_', ' '), '.pdf', '') || '第' || page_num || '页中，' || company || '的' || indicator || '是多少？'
      || CASE WHEN unit IN ('亿元', '万元') THEN '（单位：' || unit || '）' ELSE '' END AS query FROM filings""",
)
def question_templates(t):
    short = F.replace(F.replace("source", F.lit("_年报_"), F.lit(" ")), F.lit(".pdf"), F.lit(""))
    return filings(t).select(
        "chunk_id",
        X.fact_question(short, F.col("page_num"), F.col("company"), F.col("indicator"), F.col("unit")).alias("query"),
    )


_COMPARE_SQL = """cmp AS (SELECT a.chunk_id, a.doc || '第' || a.page_num || '页和' || b.doc || '第' || b.page_num || '页的营业收入哪个高？' AS query,
  a.doc AS d1, b.doc AS d2, a.page_num AS p1, b.page_num AS p2, a.revenue AS r1, b.revenue AS r2,
  CASE WHEN a.chunk_id % 3 = 0 THEN a.answer || '、' || b.answer ELSE a.answer || '高于' || b.answer END AS answer
  FROM filings a JOIN filings b ON b.chunk_id = a.chunk_id + 1)"""


@register(
    "comparison_decompose",
    f"""WITH {FILINGS_SQL}, {_COMPARE_SQL}
    SELECT chunk_id, 0::BIGINT AS half, d1 || '.pdf' AS source, CAST(p1 AS VARCHAR) AS page, CASE WHEN chunk_id % 3 = 0 THEN r1 || ' ' || r2 ELSE r1 END AS numbers FROM cmp
    UNION ALL SELECT chunk_id, 1, d2 || '.pdf', CAST(p2 AS VARCHAR), CASE WHEN chunk_id % 3 = 0 THEN r1 || ' ' || r2 ELSE r2 END FROM cmp""",
)
def comparison_decompose(t):
    data = filings(t)
    second = data.select(
        (F.col("chunk_id") - 1).alias("chunk_id"), F.col("doc").alias("doc2"), F.col("page_num").alias("page2"), F.col("answer").alias("answer2")
    )
    query = F.concat("doc", F.lit("第"), "page_num", F.lit("页和"), "doc2", F.lit("第"), "page2", F.lit("页的营业收入哪个高？"))
    joiner = F.when(F.col("chunk_id") % 3 == 0, "、").otherwise("高于")
    pairs = data.join(second, "chunk_id").select("chunk_id", query.alias("query"), F.concat("answer", joiner, "answer2").alias("answer"))
    halves = each_struct(pairs, ["chunk_id"], R.comparison_halves("query", "answer"), "half")
    return halves.select(
        "chunk_id", F.col("half").cast("bigint").alias("half"), "source", "page", F.array_join("numbers", " ").alias("numbers")
    )


# --- names and indicators ---------------------------------------------------------------------


@register(
    "filename_metadata",
    f"""WITH {FILINGS_SQL}, p AS (SELECT chunk_id, source, string_split(replace(source, '.pdf', ''), '_') AS p FROM filings)
    SELECT chunk_id, p[1] AS industry, p[2] AS company, p[3] AS vendor, p[4] AS seq, CASE WHEN source LIKE 'H3\\_%' ESCAPE '\\' THEN '' ELSE p[2] END AS named FROM p""",
)
def filename_metadata(t):
    parts = filings(t).select("chunk_id", X.source_metadata("source").alias("m"), X.source_company("source").alias("named"))
    return parts.select("chunk_id", "m.*", "named")


def _sql(text):
    return text.replace("'", "''")


def _unit_sql(pattern, indicator):
    if indicator in C.AMOUNT_INDICATORS:
        span = f"regexp_extract(text, '(?s)(?:{_sql(pattern)}).{{0,5}}', 0)"
        return f"CASE WHEN contains({span}, '亿') THEN '亿元' WHEN contains({span}, '万') THEN '万元' WHEN contains({span}, '元') THEN '元' ELSE '' END"
    return "'%'" if indicator in C.PERCENT_INDICATORS else "'元'"


_CANDIDATES = " UNION ALL ".join(
    f"SELECT chunk_id, {n} AS pattern_no, '{name}' AS indicator, regexp_extract(text, '{_sql(p)}', 1) AS value, {_unit_sql(p, name)} AS unit "
    f"FROM filings WHERE regexp_matches(text, '{_sql(p)}')"
    for n, (p, name) in enumerate(C.INDICATOR_PATTERNS)
)


@register(
    "indicator_extract",
    f"""WITH {FILINGS_SQL}, c AS ({_CANDIDATES}), f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, indicator ORDER BY pattern_no) AS r FROM c)
    SELECT chunk_id, indicator, CAST(pattern_no AS BIGINT) AS pattern_no, value, unit FROM f WHERE r = 1""",
)
def indicator_extract(t):
    found = X.first_per_indicator(X.indicator_candidates("text"))
    rows = each_struct(filings(t), ["chunk_id"], found, "indicator")
    return rows.select("chunk_id", "indicator", F.col("pattern_no").cast("bigint").alias("pattern_no"), "value", "unit")


_WITH_UNIT = " UNION ALL ".join(
    f"SELECT chunk_id, '{name}' AS indicator, trim(regexp_extract(text, '{_sql(p)}', 1)) AS value FROM filings WHERE regexp_matches(text, '{_sql(p)}')"
    for p, name in C.VALUE_WITH_UNIT_PATTERNS
)


@register(
    "indicator_values",
    f"""WITH {FILINGS_SQL}, c AS ({_WITH_UNIT}) SELECT chunk_id, indicator, value,
      CASE WHEN contains(value, '亿元') THEN '亿元' WHEN contains(value, '万元') THEN '万元' WHEN contains(value, '元') THEN '元' WHEN contains(value, '%') THEN '%' ELSE '' END AS unit FROM c""",
)
def indicator_values(t):
    return each_struct(filings(t), ["chunk_id"], X.values_with_unit("text"), "indicator")


def _all_sql(p, name):
    both = "(亿元|万元|元)" in p
    value = f"unnest(regexp_extract_all(text, '{_sql(p)}', 1))"
    if both:
        value += f" || unnest(regexp_extract_all(text, '{_sql(p)}', 2))"
    return f"SELECT chunk_id, '{name}' AS indicator, {value} AS value, generate_subscripts(regexp_extract_all(text, '{_sql(p)}', 1), 1) - 1 AS ord FROM filings"


@register(
    "indicator_all_values",
    f"""WITH {FILINGS_SQL}, c AS ({' UNION ALL '.join(_all_sql(p, n) for p, n in C.ALL_VALUE_PATTERNS)}) SELECT chunk_id, indicator, CAST(ord AS BIGINT) AS ord, value FROM c""",
)
def indicator_all_values(t):
    rows = each_struct(filings(t), ["chunk_id"], X.all_values("text"), "indicator")
    return rows.select("chunk_id", "indicator", F.col("ord").cast("bigint").alias("ord"), "value")


_CONTEXTS = " UNION ALL ".join(
    f"""SELECT chunk_id, company, '{name}' AS indicator, CASE {' '.join(f"WHEN contains(text, '{k}') THEN strpos(text, '{k}')" for k in keys)} ELSE 0 END AS pos, text FROM filings"""
    for name, keys in C.CONTEXT_KEYWORDS.items()
)
_CONTEXT_SQL = f"""kw AS ({_CONTEXTS}),
ctx AS (SELECT chunk_id, company, indicator, trim(replace(substr(text, greatest(pos - 5, 1), pos + 80 - greatest(pos - 5, 1)), chr(10), ' ')) AS context FROM kw WHERE pos > 0)"""


@register("indicator_context", f"WITH {FILINGS_SQL}, {_CONTEXT_SQL} SELECT chunk_id, indicator, context FROM ctx")
def indicator_context(t):
    return each_struct(filings(t), ["chunk_id"], X.keyword_contexts("text"), "indicator")


@register(
    "argmax_context",
    f"""WITH {FILINGS_SQL}, {_CONTEXT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company, indicator ORDER BY length(context) DESC, chunk_id) AS r FROM ctx)
    SELECT company, indicator, chunk_id, context FROM r WHERE r = 1""",
)
def argmax_context(t):
    contexts = each_struct(filings(t), ["chunk_id", "company"], X.keyword_contexts("text"), "indicator")
    return M.longest_context(contexts, [F.asc("chunk_id")]).select("company", "indicator", "chunk_id", "context")


_FLAGS = ", ".join(
    f"""CASE WHEN {' OR '.join(f"contains(text, '{k}')" for k in keys)} THEN '{name}' END""" for name, keys in C.INDICATOR_KEYWORDS.items()
)


@register("keyword_flags", f"WITH {FILINGS_SQL} SELECT chunk_id, array_to_string([{_FLAGS}], ' ') AS indicators FROM filings")
def keyword_flags(t):
    return filings(t).select("chunk_id", F.array_join(X.indicator_flags("text"), " ").alias("indicators"))


@register(
    "keyword_first",
    f"""WITH {FILINGS_SQL}, k AS (SELECT chunk_id, CASE WHEN length(text) > 100 THEN list_filter([{quoted(C.SUMMARY_KEYWORDS)}], lambda w: contains(text, w))[1] END AS keyword FROM filings)
    SELECT chunk_id, keyword FROM k WHERE keyword IS NOT NULL""",
)
def keyword_first(t):
    return each(filings(t), ["chunk_id"], F.array(X.summary_keyword("text")), "keyword")


@register(
    "narrative_candidates",
    f"""WITH {FILINGS_SQL}, b AS (SELECT chunk_id, replace(repeat(text, 3), '[', '') AS text FROM filings),
    k AS (SELECT chunk_id, list_filter([{quoted(C.NARRATIVE_KEYWORDS)}], lambda w: contains(text, w)) AS found FROM b WHERE length(text) >= 300 AND text NOT LIKE '[%')
    SELECT chunk_id, array_to_string(found, ' ') AS keywords FROM k WHERE len(found) >= 3""",
)
def narrative_candidates(t):
    body = filings(t).select("chunk_id", F.replace(F.repeat("text", 3), F.lit("["), F.lit("")).alias("text"))
    found = body.select("chunk_id", X.narrative_keywords("text").alias("found")).where("found IS NOT NULL")
    return found.select("chunk_id", F.array_join("found", " ").alias("keywords"))


# --- ground truth -----------------------------------------------------------------------------


@register(
    "answer_in_text",
    f"""WITH {FILINGS_SQL}, v AS (SELECT chunk_id, replace(text, CASE WHEN chunk_id % 2 = 0 THEN ',' ELSE '#' END, '') AS text,
      CASE chunk_id % 3 WHEN 0 THEN answer WHEN 1 THEN '约' || revenue || '左右' ELSE '不详' END AS answer FROM filings),
    n AS (SELECT *, regexp_extract(answer, '[0-9,]+(?:\\.[0-9]+)?', 0) AS num, regexp_replace(answer, '[^0-9.%]', '', 'g') AS digits FROM v)
    SELECT chunk_id, contains(text, answer) OR contains(text, replace(answer, ',', '')) OR (num <> '' AND (contains(text, num) OR contains(text, replace(num, ',', '')))) AS found,
      contains(text, answer) OR contains(text, digits) AS found_digits FROM n""",
)
def answer_in_text(t):
    text = F.when(F.col("chunk_id") % 2 == 0, F.replace("text", F.lit(","), F.lit(""))).otherwise(F.replace("text", F.lit("#"), F.lit("")))
    answer = (
        F.when(F.col("chunk_id") % 3 == 0, F.col("answer"))
        .when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("约"), "revenue", F.lit("左右")))
        .otherwise("不详")
    )
    data = filings(t).select("chunk_id", text.alias("text"), answer.alias("answer"))
    return data.select(
        "chunk_id", A.answer_in_text("text", "answer").alias("found"), A.digits_in_text("text", "answer").alias("found_digits")
    )


_SAMPLES_SQL = """samples AS (SELECT chunk_id AS query_id, CASE WHEN chunk_id % 4 = 1 THEN 'moved_' || source ELSE source END AS source_file,
  CAST(CASE WHEN chunk_id % 11 = 0 THEN 99 ELSE page_num END AS VARCHAR) AS page_num, string_split(doc, '_')[2] AS company, answer FROM filings)"""


def samples(data):
    return data.select(
        F.col("chunk_id").alias("query_id"),
        F.when(F.col("chunk_id") % 4 == 1, F.concat(F.lit("moved_"), "source")).otherwise(F.col("source")).alias("source_file"),
        F.when(F.col("chunk_id") % 11 == 0, 99).otherwise(F.col("page_num")).cast("string").alias("page_num"),
        F.get(F.split("doc", "_"), F.lit(1)).alias("company"),
        "answer",
    )


@register(
    "gt_remap",
    f"""WITH {FILINGS_SQL}, {_SAMPLES_SQL},
    vals AS (SELECT query_id, source_file, page_num, company, unnest(regexp_extract_all(answer, '[0-9,.]+')) AS v FROM samples),
    c AS (SELECT chunk_id, source, CASE WHEN source LIKE 'H3\\_%' ESCAPE '\\' THEN '' ELSE string_split(doc, '_')[2] END AS company, CAST(page_num AS VARCHAR) AS page_num, replace(text, ',', '') AS text FROM filings),
    e AS (SELECT query_id, min(chunk_id) AS chunk_id FROM vals JOIN c ON source_file = c.source AND vals.page_num = c.page_num AND contains(text, replace(v, ',', '')) GROUP BY 1),
    f AS (SELECT query_id, min(chunk_id) AS chunk_id FROM vals JOIN c ON vals.company = c.company AND vals.page_num = c.page_num AND contains(text, replace(v, ',', '')) GROUP BY 1)
    SELECT query_id, coalesce(e.chunk_id, f.chunk_id) AS chunk_id, CASE WHEN e.chunk_id IS NOT NULL THEN 'file' WHEN f.chunk_id IS NOT NULL THEN 'company' END AS matched_by
    FROM samples LEFT JOIN e USING (query_id) LEFT JOIN f USING (query_id)""",
)
def gt_remap(t):
    data = filings(t)
    return M.remap_truth(samples(data), data)


_TYPED_SQL = """typed AS (
    SELECT a.chunk_id AS query_id, CASE a.chunk_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'summary' ELSE 'comparison' END AS query_type,
      a.doc || '第' || a.page_num || '页和' || b.doc || '第' || CASE WHEN a.chunk_id % 7 = 0 THEN 98 ELSE b.page_num END || '页相比' AS query,
      CASE WHEN a.chunk_id % 4 = 1 THEN 'moved_' || a.source WHEN a.chunk_id % 5 = 0 THEN a.doc ELSE a.source END AS source_file,
      CAST(CASE WHEN a.chunk_id % 11 = 0 THEN 99 ELSE a.page_num END AS {text}) AS page_num, split_part(a.doc, '_', 2) AS company,
      CASE WHEN a.chunk_id % 3 = 2 THEN a.answer || '高于' || b.answer WHEN a.chunk_id % 3 = 1 AND a.chunk_id % 2 = 0 THEN '向好，行业发展趋势向好，政策支持' ELSE a.answer END AS answer
    FROM filings a JOIN filings b ON b.chunk_id = a.chunk_id + 1)"""


@register(
    "gt_locate",
    f"""WITH {FILINGS_SQL}, {_TYPED_SQL.format(text='VARCHAR')},
    places AS (
      SELECT query_id, 0 AS half, source_file AS name, company, page_num AS page, CASE WHEN regexp_matches(answer, '[0-9,.]') THEN regexp_extract_all(answer, '[0-9,.]+')
        WHEN query_type = 'summary' THEN [coalesce(list_filter(string_split(answer, '，'), lambda c: length(c) > 4)[1], left(answer, 8))] ELSE [] END AS vals FROM typed WHERE query_type <> 'comparison'
      UNION ALL
      SELECT query_id, h AS half, regexp_extract(string_split(query, '和')[h + 1], '([^ ]+?)第([0-9]+)页', 1) || '.pdf', split_part(regexp_extract(string_split(query, '和')[h + 1], '([^ ]+?)第([0-9]+)页', 1), '_', 2),
        regexp_extract(string_split(query, '和')[h + 1], '([^ ]+?)第([0-9]+)页', 2), regexp_extract_all(string_split(answer, '高于')[h + 1], '[0-9,.]+') FROM typed, (VALUES (0), (1)) t(h) WHERE query_type = 'comparison'),
    clauses AS (SELECT * EXCLUDE vals, replace(unnest(vals), ',', '') AS v FROM places),
    chunks AS (SELECT chunk_id, source, CAST(page_num AS VARCHAR) AS page, replace(text, ',', '') AS text FROM filings),
    e AS (SELECT query_id, half, min(chunk_id) AS chunk_id, 'file' AS way FROM clauses c JOIN chunks k ON c.page = k.page AND contains(k.source, c.name) AND contains(k.text, c.v) GROUP BY 1, 2),
    f AS (SELECT query_id, half, min(chunk_id) AS chunk_id, 'company' AS way FROM (SELECT * FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = c.query_id AND e.half = c.half)) c
      JOIN chunks k ON c.page = k.page AND contains(k.source, c.company) AND contains(k.text, c.v) GROUP BY 1, 2),
    found AS (SELECT query_id, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY half) AS ids, string_agg(way, ',' ORDER BY half) AS ways FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY 1)
    SELECT t.query_id, query_type, CASE WHEN n >= CASE WHEN query_type = 'comparison' THEN 2 ELSE 1 END THEN ids END AS chunk_ids,
      CASE WHEN n >= CASE WHEN query_type = 'comparison' THEN 2 ELSE 1 END THEN ways END AS matched_by FROM typed t LEFT JOIN found USING (query_id)""",
)
def gt_locate(t):
    """Facts, summaries and comparisons located by parts of file names, by company and in company-less files."""
    data = write_through(filings(t).select("chunk_id", "source", "doc", "page_num", "text", "answer"), "filings", compression="zstd")
    typed = t.spark.sql(f"WITH {_TYPED_SQL.format(text='STRING')} SELECT * FROM typed".replace("filings", "{data}"), data=data)
    return locate_truth(typed, data)


@register(
    "verify_samples",
    f"""WITH {FILINGS_SQL}, {_SAMPLES_SQL}
    SELECT query_id, f.chunk_id IS NOT NULL AS chunk_found, coalesce(contains(text, s.answer) OR contains(text, replace(s.answer, ',', '')) OR contains(text, regexp_extract(s.answer, '[0-9,]+(?:\\.[0-9]+)?', 0)), false) AS answer_ok,
      coalesce(source = source_file, false) AS source_ok, coalesce(CAST(f.page_num AS VARCHAR) = s.page_num, false) AS page_ok
    FROM samples s LEFT JOIN filings f ON f.chunk_id = s.query_id + 1""",
)
def verify_samples(t):
    data = filings(t)
    wanted = samples(data).withColumn("chunk_id", F.col("query_id") + 1)
    return M.verify_samples(wanted, data)


@register(
    "truth_ids",
    """SELECT query_id, id FROM (
      SELECT o_custkey AS query_id, trim(unnest(string_split(o_orderkey || ' , ,' || (o_orderkey + 1) || ',', ','))) AS id FROM orders) WHERE id <> ''""",
)
def truth_ids(t):
    joined = F.concat(F.col("o_orderkey").cast("string"), F.lit(" , ,"), (F.col("o_orderkey") + 1).cast("string"), F.lit(","))
    return t.raw("orders").select(F.col("o_custkey").alias("query_id"), F.explode(R.split_ids(joined)).alias("id"))


# --- companies --------------------------------------------------------------------------------


@register(
    "comparison_pairs",
    f"""WITH {FILINGS_SQL}, d AS (SELECT DISTINCT company, indicator, md5('42|' || company) AS key FROM filings),
    n AS (SELECT *, substr(key, 1, 2) AS bucket, row_number() OVER (PARTITION BY indicator, substr(key, 1, 2) ORDER BY key, company) - 1 AS place FROM d),
    p AS (SELECT indicator, bucket, place // 2 AS pair, min(company) AS first, max(company) AS second, count(*) AS n FROM n GROUP BY 1, 2, 3)
    SELECT indicator, first, second, first || '和' || second || '的' || indicator || '对比如何？' AS query FROM p WHERE n = 2""",
)
def comparison_pairs(t):
    return M.comparison_pairs(filings(t))


@register(
    "indicator_pairs",
    f"""WITH {FILINGS_SQL}, d AS (SELECT company, indicator, md5('42|' || company) AS key, first(source ORDER BY source, answer) AS source, first(answer ORDER BY source, answer) AS answer FROM filings GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY key, company) - 1 AS pos FROM d)
    SELECT a.indicator, a.company AS first, b.company AS second, a.company || '和' || b.company || '的' || a.indicator || '对比如何？' AS query,
      a.company || ': ' || a.answer || chr(10) || b.company || ': ' || b.answer AS answer, a.source || '; ' || b.source AS source_file
    FROM n a JOIN n b ON a.indicator = b.indicator AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0""",
)
def indicator_pairs(t):
    """Every company paired, over all ranges."""
    return M.indicator_pairs(filings(t))


@register(
    "company_summary",
    f"""WITH {FILINGS_SQL}, u AS (SELECT company, source, page_num, length(text) AS n, [{_FLAGS}] AS flags FROM filings),
    tot AS (SELECT company, count(*) AS n_files, CAST(sum(page_num) AS BIGINT) AS total_pages, CAST(sum(n % 3) AS BIGINT) AS total_tables FROM u GROUP BY 1),
    ind AS (SELECT company, string_agg(DISTINCT f, ' ' ORDER BY f) AS indicators, count(DISTINCT f) AS k FROM (SELECT company, unnest(flags) AS f FROM u) WHERE f IS NOT NULL GROUP BY 1)
    SELECT company, n_files, total_pages, total_tables, coalesce(indicators, '') AS indicators, coalesce(k, 0) > 0 AND n_files >= 3 AND company NOT IN ({quoted(C.COMPANY_BLOCKLIST)}) AS usable
    FROM tot LEFT JOIN ind USING (company)""",
)
def company_summary(t):
    documents = filings(t).select(
        "source",
        "company",
        F.col("page_num").alias("n_pages"),
        (F.length("text") % 3).alias("n_tables"),
        X.indicator_flags("text").alias("indicators"),
    )
    summary = M.company_summary(documents)
    return summary.withColumn("indicators", F.array_join("indicators", " "))


@register(
    "distinct_sources",
    f"""WITH {FILINGS_SQL}, d AS (SELECT DISTINCT industry, source FROM filings), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY source) AS place FROM d)
    SELECT industry, source, place FROM r WHERE place <= 5""",
)
def distinct_sources(t):
    return first_n(filings(t).select("industry", "source").distinct(), ["industry"], [F.asc("source")], 5)
