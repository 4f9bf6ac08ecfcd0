"""Registry, derived tables and shared SQL fragments.

Chinese filings are derived row by row from orders and customers, so that every text rule runs
over data that grows with the tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.models import HashEncoder
from paperloom.operators import lexical
from paperloom.operators.dense import dense_topk, mean_vectors
from paperloom.operators.rows import each, parts_for, spread
from paperloom.session import fits_broadcast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64
TEXT_TABLES = {"documents", "pages", "conversations", "orders"}


class Tables:
    """The given tables by name: ``Tables(spark, folder).documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.raw(name)) if name in TEXT_TABLES else self.raw(name)

    def raw(self, name: str) -> DataFrame:
        """The table as stored, for work that is cheap per row."""
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))


def register(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name, with its SQL check if there is one."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- filings: one statement and one question per order ---------------------------------------

_INDICATOR_BY_PRIORITY = {
    "1-URGENT": "营收",
    "2-HIGH": "净利润",
    "3-MEDIUM": "毛利率",
    "4-NOT SPECIFIED": "ROE",
    "5-LOW": "归母净利",
}
_UNIT_BY_PRIORITY = {"1-URGENT": "亿元", "2-HIGH": "万元", "3-MEDIUM": "元", "4-NOT SPECIFIED": "亿元", "5-LOW": "亿元"}


def _case(column: str, mapping: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {branches} END"


def _money(column: str, engine: str) -> str:
    return f"format_number({column}, 2)" if engine == "spark" else f"format('{{:,.2f}}', {column})"


def filings_select(engine: str) -> str:
    """The same SELECT for both engines, but for the number format function."""
    return f"""
SELECT chunk_id, seq, industry, company, unit, indicator, revenue, profit, page_num, shout, doc,
  doc || '.pdf' AS source,
  '[' || doc || '.pdf 第' || page_num || '页] ' || shout || '报告期内公司实现营业收入' || revenue || unit
    || '，归属于上市公司股东的净利润' || profit || '万元。毛利率' || margin || '%，同比增长' || growth
    || '%。基本每股收益' || eps || '元，总资产：' || revenue || ' 亿元。' AS text,
  '在' || doc || '第' || page_num || '页中，' || company || '的' || indicator || '是多少？'
    || CASE WHEN unit IN ('亿元', '万元') THEN '（单位：' || unit || '）' ELSE '' END AS query,
  revenue || unit AS answer
FROM (
  SELECT *,
    CASE WHEN status = 'P' THEN 'H3_' ELSE '' END || industry || '_' || company || '_年报_' || seq AS doc
  FROM (
    SELECT o_orderkey AS chunk_id, o_orderkey % 10 AS seq, c_mktsegment AS industry,
      o_orderstatus AS status,
      '公司' || translate(CAST(o_custkey AS {'STRING' if engine == 'spark' else 'VARCHAR'}), '0123456789', '零一二三四五六七八九') AS company,
      {_case('o_orderpriority', _UNIT_BY_PRIORITY)} AS unit,
      {_case('o_orderpriority', _INDICATOR_BY_PRIORITY)} AS indicator,
      {_money('o_totalprice', engine)} AS revenue,
      {_money('abs(c_acctbal)', engine)} AS profit,
      (o_orderkey % 89) || '.' || (o_orderkey % 7) AS margin,
      (o_orderkey % 31) || '.' || (o_orderkey % 9) AS growth,
      (o_orderkey % 5) || '.' || (o_orderkey % 97) AS eps,
      CASE WHEN o_orderkey % 6 = 0 THEN '行业发展趋势向好，政策支持，市场规模扩大。' ELSE '' END AS shout,
      CAST(o_orderkey % 12 + 1 AS BIGINT) AS page_num
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) AS fields
) AS named
"""


FILINGS_SQL = f"filings AS ({filings_select('duckdb')})"


TASK_FILINGS = 1 << 16  # filings written by one task


def filings(t: Tables) -> DataFrame:
    """Orders and customers are joined first; texts are written in tasks of a bounded number of rows."""
    named = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    customer = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    parts = parts_for(t.raw("orders"), t.raw("orders").count(), TASK_FILINGS)
    large = parts > t.spark.sparkContext.defaultParallelism
    orders = t.raw("orders") if large else t.orders
    joined = orders.select(*named).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.repartition(parts) if large else joined
    return t.spark.sql(filings_select("spark").replace("FROM orders JOIN customer ON o_custkey = c_custkey", "FROM {joined}"), joined=joined)


# --- tokens, lexical and dense runs of benchmark questions against documents -----------------

TOKEN_REGEX = r"[a-zA-Z]{2,}|[0-9]+\.?[0-9]*|" + "|".join(
    [
        *sorted((w for w in C.FINANCE_TERMS if len(w) <= 4 and not w.isascii()), key=len, reverse=True),
        "[一-鿿]",
    ]
)


def tokens_sql(text: str) -> str:
    terms = f"list_filter([{quoted(C.FINANCE_TERMS)}], lambda w: contains({text}, w))"
    words = (
        f"list_filter(list_transform(regexp_extract_all({text}, '{TOKEN_REGEX}'), lambda w: lower(w)), "
        f"lambda w: w NOT IN ({quoted(C.STOPWORDS)}))"
    )
    return f"list_concat({terms}, {words})"


def bm25_sql(k: int, docs: str, queries: str, out: str = "brun") -> str:
    """CTEs ending in ``out(query_id, id, score, rank)``; docs(id, text), queries(query_id, query)."""
    return f"""
{out}_tok AS (SELECT id, {tokens_sql('text')} AS tokens FROM ({docs})),
{out}_len AS (SELECT id, len(tokens) AS dl FROM {out}_tok),
{out}_corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {out}_len),
{out}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM {out}_tok) GROUP BY id, term),
{out}_df AS (SELECT term, count(*) AS df FROM {out}_tf GROUP BY term),
{out}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM ({queries})) GROUP BY 1, 2),
{out}_s AS (
  SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1)
      * tf * (1.5 + 1) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {out}_q JOIN {out}_df USING (term) JOIN {out}_tf USING (term) JOIN {out}_len USING (id), {out}_corpus
  GROUP BY query_id, id),
{out} AS (
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM {out}_s WHERE score > 0) WHERE rank <= {k})"""


def hash_vectors_sql(source: str, out: str, dim: int = DIM) -> str:
    """CTE ``out(id, slot, w)`` with the float32 components of hashed unit vectors."""
    return f"""
{out}_raw AS (
  SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS slot,
    sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS w
  FROM (SELECT id, unnest({tokens_sql('text')}) AS term FROM ({source})) GROUP BY 1, 2),
{out}_norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {out}_raw GROUP BY id),
{out}_unit AS (
  SELECT id, slot, CAST(CAST(CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS FLOAT) AS DOUBLE) AS w
  FROM {out}_raw JOIN {out}_norm USING (id)),
{out}_renorm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {out}_unit GROUP BY id),
{out} AS (
  SELECT id, slot, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS w
  FROM {out}_unit JOIN {out}_renorm USING (id))"""


def dense_sql(k: int, docs: str, queries: str, out: str = "vrun") -> str:
    """CTEs ending in ``out(query_id, id, score, rank)`` by hashed vectors, exact over all pairs."""
    return f"""
{hash_vectors_sql(docs, out + '_d')},
{hash_vectors_sql(queries, out + '_q')},
{out}_ids AS (SELECT id FROM ({docs})),
{out}_qids AS (SELECT id AS query_id FROM ({queries})),
{out}_dot AS (
  SELECT q.id AS query_id, d.id AS id, sum(q.w * d.w) AS dot
  FROM {out}_q q JOIN {out}_d d USING (slot) GROUP BY 1, 2),
{out}_s AS (
  SELECT query_id, id, round(coalesce(dot, 0.0), 6) AS score
  FROM (SELECT query_id, id FROM {out}_qids, {out}_ids) LEFT JOIN {out}_dot USING (query_id, id)),
{out} AS (
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM {out}_s) WHERE rank <= {k})"""


DOCS_SQL = "SELECT doc_id AS id, text FROM documents"
ASKED_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"
ASKED_VECTOR_SQL = "SELECT item_id AS id, text FROM benchmark"


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_run(t: Tables, k: int) -> DataFrame:
    return lexical.search_chunks(t.raw("documents"), asked(t), k, id_col="doc_id")  # spreads by size itself


def document_vectors(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", HashEncoder(DIM).encode("text").alias("embedding"))


def vector_run(t: Tables, k: int) -> DataFrame:
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), HashEncoder(DIM).encode("text").alias("embedding"))
    return dense_topk(document_vectors(t), questions, k, id_col="doc_id")


def runs_sql(k: int) -> str:
    return bm25_sql(k, DOCS_SQL, ASKED_SQL) + "," + dense_sql(k, DOCS_SQL, ASKED_VECTOR_SQL)


# --- judgements: documents that share a sentence with a question ------------------------------

JUDGED_SQL = """
bsent AS (SELECT DISTINCT item_id, trim(s) AS s FROM (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS s FROM benchmark) WHERE length(trim(s)) > 20),
dsent AS (SELECT DISTINCT doc_id, trim(s) AS s FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS s FROM documents) WHERE length(trim(s)) > 20),
judged AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM bsent JOIN dsent USING (s))"""


def judged(t: Tables) -> DataFrame:
    def sentences(df: DataFrame, key: str) -> DataFrame:
        parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
        kept = F.array_distinct(F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > 20))
        return each(df, [key], kept, "s")

    wanted = sentences(t.benchmark, "item_id")
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    pairs = sentences(t.documents, "doc_id").join(side, "s")
    return pairs.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id")).distinct()


# --- label questions over the given embeddings ------------------------------------------------


def label_queries(t: Tables) -> DataFrame:
    """Mean vector of every label as the question; vectors of the same label are relevant."""
    means = mean_vectors(t.embeddings, "label")
    return means.select(F.col("label").cast("bigint").alias("query_id"), "embedding")


LABEL_SQL = """
emb AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
comp AS (SELECT id, label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM emb),
mean AS (SELECT label, pos, avg(x) AS x FROM comp GROUP BY 1, 2),
lq AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS q FROM mean GROUP BY 1),
sim AS (
  SELECT query_id, id, label,
    round(list_inner_product(q, e) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(e, e))), 6) AS score
  FROM lq, emb)"""
