"""Retrieval quality over documents and embeddings."""

from pyspark.sql import functions as F

from paperloom.constants import HIT_CUTOFFS
from paperloom.operators import evaluation as E
from paperloom.operators.dense import dense_topk
from paperloom.operators.fusion import hybrid, merge_by_score
from paperloom.plans.experiments import compare_runs
from paperloom.session import write_through
from workload.base import JUDGED_SQL, LABEL_SQL, asked, judged, label_queries, lexical_run, register, runs_sql, vector_run

_LABEL_RUN = f"""{LABEL_SQL},
run AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 50),
rel AS (SELECT CAST(label AS BIGINT) AS query_id, vec_id AS id FROM embeddings),
asked AS (SELECT query_id FROM lq)"""


def metrics_sql(run: str, rel: str, asked_table: str, out: str) -> str:
    """CTE ``out`` with the metrics of every query."""
    return f"""
{out}_n AS (SELECT query_id, count(*) AS n_relevant FROM {rel} GROUP BY 1),
{out}_hit AS (SELECT r.query_id, r.rank, j.id IS NOT NULL AS hit FROM {run} r LEFT JOIN {rel} j ON j.query_id = r.query_id AND j.id = r.id),
{out}_agg AS (SELECT query_id, count(*) AS n_retrieved, count(*) FILTER (hit) AS n_hits, min(rank) FILTER (hit) AS first_rank,
  sum(1 / log2(rank + 1)) FILTER (hit) AS gain, count(*) FILTER (hit AND rank <= 3) AS h3, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (hit AND rank <= 10) AS h10 FROM {out}_hit GROUP BY 1),
{out} AS (SELECT query_id, coalesce(n_relevant, 0) AS n_relevant, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_hits, 0) AS n_hits,
  coalesce(h3 / n_relevant, 0) AS recall_3, coalesce(h5 / n_relevant, 0) AS recall_5, coalesce(h10 / n_relevant, 0) AS recall_10,
  coalesce(1 / first_rank, 0) AS mrr,
  coalesce(gain / list_sum(list_transform(range(1, least(n_relevant, n_retrieved) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg
  FROM {asked_table} LEFT JOIN {out}_n USING (query_id) LEFT JOIN {out}_agg USING (query_id))"""


def _label_run(t, k=50):
    return dense_topk(t.embeddings, label_queries(t), k, id_col="vec_id")


def _relevant(t):
    return t.embeddings.select(F.col("label").cast("bigint").alias("query_id"), F.col("vec_id").alias("id"))


def _per_label(t):
    return E.per_query(_label_run(t), _relevant(t), label_queries(t))


@register(
    "recall_at_k",
    f"WITH {_LABEL_RUN}, {metrics_sql('run', 'rel', 'asked', 'm')} SELECT query_id, n_relevant, round(recall_3, 6) AS recall_3, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10 FROM m",
)
def recall_at_k(t):
    names = ["recall_3", "recall_5", "recall_10"]
    return _per_label(t).select("query_id", "n_relevant", *[F.round(n, 6).alias(n) for n in names])


@register("mrr", f"WITH {_LABEL_RUN}, {metrics_sql('run', 'rel', 'asked', 'm')} SELECT query_id, n_hits, round(mrr, 6) AS mrr FROM m")
def mrr(t):
    return _per_label(t).select("query_id", "n_hits", F.round("mrr", 6).alias("mrr"))


@register("ndcg", f"WITH {_LABEL_RUN}, {metrics_sql('run', 'rel', 'asked', 'm')} SELECT query_id, n_retrieved, round(ndcg, 6) AS ndcg FROM m")
def ndcg(t):
    return _per_label(t).select("query_id", "n_retrieved", F.round("ndcg", 6).alias("ndcg"))


def _runs_sql(k: int) -> str:
    return f"""{runs_sql(k)}, {JUDGED_SQL},
fj AS (SELECT query_id, id, v.rank AS v_rank, b.rank AS b_rank, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS s FROM vrun v FULL OUTER JOIN brun b USING (query_id, id)),
hrun AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, v_rank ASC NULLS LAST, b_rank ASC NULLS LAST) AS rank FROM fj) WHERE rank <= {k}),
asked AS (SELECT item_id AS query_id, CASE length(text) % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'comparison' ELSE 'summary' END AS query_type FROM benchmark)"""


#: Candidates of each side in comparisons and in the diagnosis of ranks.
COMPARED, DIAGNOSED = 200, 500
_RUNS = _runs_sql(50)
_MERGED = f"""{_runs_sql(DIAGNOSED)},
both_sides AS (SELECT query_id, id, 0 AS side, score, rank AS side_rank FROM vrun UNION ALL SELECT query_id, id, 1, score, rank FROM brun),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY side) AS r FROM both_sides) WHERE r = 1),
merged AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, side_rank) AS rank FROM once)"""

_AVG = """SELECT '{name}' AS method, count(*) AS n_queries, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10,
  round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM {table}"""


@register(
    "compare_methods",
    f"""WITH {_runs_sql(COMPARED)}, {metrics_sql('vrun', 'judged', 'asked', 'mv')}, {metrics_sql('brun', 'judged', 'asked', 'mb')}, {metrics_sql('hrun', 'judged', 'asked', 'mh')}
    {_AVG.format(name='vector', table='mv')} UNION ALL {_AVG.format(name='bm25', table='mb')} UNION ALL {_AVG.format(name='hybrid', table='mh')}""",
)
def compare_methods(t):
    # short lists that several methods read: searched once
    vector = write_through(vector_run(t, COMPARED), "vector-run")
    lexical = write_through(lexical_run(t, COMPARED), "lexical-run")
    runs = {"vector": vector, "bm25": lexical, "hybrid": hybrid(vector, lexical, limit=COMPARED)}
    return compare_runs(runs, judged(t), asked(t))


def _typed(t):
    n = F.length("text") % 3
    name = F.when(n == 0, "fact").when(n == 1, "comparison").otherwise("summary")
    return t.benchmark.select(F.col("item_id").alias("query_id"), name.alias("query_type"))


def _ranks(t):
    return E.hit_ranks(lexical_run(t, 50), judged(t), _typed(t))


def _deep_ranks(t):
    """Ranks in the merged lists of both searches, as deep as the deepest cutoff."""
    merged = merge_by_score(vector_run(t, DIAGNOSED), lexical_run(t, DIAGNOSED))
    return E.hit_ranks(merged, judged(t), _typed(t))


_RANKS = f"""{_RUNS}, first AS (SELECT query_id, min(rank) AS rank FROM brun JOIN judged USING (query_id, id) GROUP BY 1),
ranks AS (SELECT query_id, query_type, rank FROM asked LEFT JOIN first USING (query_id))"""
_DEEP = f"""{_MERGED}, first AS (SELECT query_id, min(rank) AS rank FROM merged JOIN judged USING (query_id, id) GROUP BY 1),
ranks AS (SELECT query_id, query_type, rank FROM asked LEFT JOIN first USING (query_id))"""


@register(
    "hit_by_type",
    f"""WITH {_RANKS} SELECT query_type, count(*) AS total, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10
    FROM ranks GROUP BY GROUPING SETS ((query_type), ())""",
)
def hit_by_type(t):
    return E.hits_by_type(_ranks(t), "query_type", [3, 5, 10])


@register(
    "hit_cutoffs",
    f"""WITH {_DEEP} SELECT query_type, count(*) AS total, {', '.join(f'count(*) FILTER (rank <= {k}) AS hit_{k}' for k in (1, 3, 5, 10, 20, 50, 100, 200, 500))}
    FROM ranks GROUP BY GROUPING SETS ((query_type), ())""",
)
def hit_cutoffs(t):
    return E.hits_by_type(_deep_ranks(t), "query_type", HIT_CUTOFFS)


@register(
    "rank_stats",
    f"""WITH {_DEEP}, o AS (SELECT query_type, rank, row_number() OVER (PARTITION BY query_type ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY query_type) AS n FROM ranks WHERE rank IS NOT NULL)
    SELECT query_type, max(n) AS n_found, max(rank) FILTER (i = n // 2) AS median_rank, round(avg(rank), 6) AS mean_rank, min(rank) AS min_rank, max(rank) AS max_rank FROM o GROUP BY 1""",
)
def rank_stats(t):
    return E.rank_statistics(_deep_ranks(t), "query_type")


@register(
    "rank_buckets",
    f"""WITH {_DEEP} SELECT CASE WHEN rank = 1 THEN '1-1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50'
      WHEN rank <= 100 THEN '51-100' WHEN rank <= 200 THEN '101-200' WHEN rank <= 500 THEN '201-500' END AS bucket, count(*) AS n_queries
    FROM ranks WHERE rank IS NOT NULL GROUP BY 1""",
)
def rank_buckets(t):
    return E.rank_buckets(_deep_ranks(t))


@register(
    "hit_class",
    f"""WITH {_RUNS}, tops AS (SELECT query_id, id, d.source AS source FROM brun JOIN documents d ON id = doc_id),
    goal AS (SELECT query_id, id, source FROM judged JOIN documents ON id = doc_id),
    c AS (SELECT query_id, EXISTS (SELECT 1 FROM goal g JOIN brun b USING (query_id, id) WHERE g.query_id = a.query_id AND b.rank <= 1) AS chunk_hit,
      EXISTS (SELECT 1 FROM goal g JOIN tops t ON g.query_id = t.query_id AND g.source = t.source WHERE g.query_id = a.query_id) AS page_hit FROM asked a),
    k AS (SELECT CASE WHEN chunk_hit THEN 'chunk' WHEN page_hit THEN 'page' ELSE 'missed' END AS hit_class FROM c)
    SELECT hit_class, count(*) AS n_queries, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1""",
)
def hit_class(t):
    run, goals = write_through(lexical_run(t, 50), "lexical-run"), write_through(judged(t), "judged")
    sources = t.documents.select(F.col("doc_id").alias("id"), "source")
    exact = run.where("rank <= 1").join(goals, ["query_id", "id"], "left_semi").select("query_id").distinct()
    seen = run.join(sources, "id").select("query_id", "source").distinct()
    same_source = goals.join(sources, "id").select("query_id", "source").distinct().join(seen, ["query_id", "source"], "left_semi")
    classes = (
        asked(t).select("query_id")
        .join(exact.withColumn("c", F.lit(True)), "query_id", "left")
        .join(same_source.select("query_id").distinct().withColumn("p", F.lit(True)), "query_id", "left")
        .select(F.coalesce("c", F.lit(False)).alias("chunk_hit"), F.coalesce("p", F.lit(False)).alias("page_hit"))
    )
    return E.hit_classes(classes)
