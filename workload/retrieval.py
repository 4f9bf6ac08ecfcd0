"""Index, search, fusion and reranking."""

import os

from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.tokens import finance_terms, segment_cjk, tokenize
from paperloom.operators import fusion, lexical
from paperloom.operators.dense import assign_lists, dense_topk, probed_topk
from paperloom.operators.matching import lookup
from paperloom.operators.rerank import cut, overlap_rerank, overlap_score, rerank_longer
from paperloom.operators.rows import each
from paperloom.plans import ingest, qa
from paperloom.plans.experiments import ann_recall
from paperloom.schemas import PAGES
from paperloom.session import shared_dir
from paperloom.sources.readers import read_vectors
from paperloom.sources.writers import write_vectors
from paperloom.streaming.ingest import ingest_stream, stream_parsed
from workload.base import (
    ASKED_SQL,
    ASKED_VECTOR_SQL,
    DOCS_SQL,
    FILINGS_SQL,
    JUDGED_SQL,
    LABEL_SQL,
    TOKEN_REGEX,
    asked,
    bm25_sql,
    dense_sql,
    document_vectors,
    filings,
    hash_vectors_sql,
    judged,
    label_queries,
    lexical_run,
    quoted,
    register,
    runs_sql,
    tokens_sql,
    vector_run,
)

RUN = ["query_id", "id", "score", "rank"]


@register("bm25_topk", f"WITH {bm25_sql(10, DOCS_SQL, ASKED_SQL)} SELECT query_id, id, score, rank FROM brun")
def bm25_topk(t):
    return lexical_run(t, 10).select(*RUN)


@register(
    "bm25_indexed",
    f"WITH {bm25_sql(20, DOCS_SQL, ASKED_SQL)} SELECT query_id, id, score, rank FROM brun",
)
def bm25_indexed(t):
    index = lexical.build_index(t.documents, "doc_id")
    return lexical.search(index, asked(t), 20).select(*RUN)


@register(
    "bm25_stored",
    f"WITH {bm25_sql(20, DOCS_SQL, ASKED_SQL)} SELECT query_id, id, score, rank FROM brun",
)
def bm25_stored(t):
    """Save the index, load it and search; only the buckets of the asked terms are read."""
    path = os.path.join(shared_dir(t.spark), f"index-{os.urandom(6).hex()}")
    lexical.build_index(t.documents, "doc_id").save(path)
    return lexical.search(lexical.LexicalIndex.load(t.spark, path), asked(t), 20).select(*RUN)


@register(
    "incremental_search",
    f"WITH {bm25_sql(20, DOCS_SQL, ASKED_SQL)} SELECT query_id, id, score, rank FROM brun",
)
def incremental_search(t):
    """Two arrivals, the second of which repeats the first, searched as if indexed at once."""
    path = os.path.join(shared_dir(t.spark), f"collection-{os.urandom(6).hex()}")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source")
    ingest.append_chunks(chunks.where("chunk_id % 3 = 0"), path)
    collection = ingest.append_chunks(chunks, path)
    return lexical.search(collection.index, asked(t), 20).select(*RUN)


_PAGED_SQL = "SELECT doc_id AS id, '[' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || ' 第1页] ' || text AS text FROM documents"


@register(
    "stream_search",
    f"WITH {bm25_sql(20, _PAGED_SQL, ASKED_SQL)} SELECT query_id, id, score, rank FROM brun",
)
def stream_search(t):
    """Two arrivals by a stream that is started three times, searched as if indexed at once."""
    root = os.path.join(shared_dir(t.spark), f"stream-{os.urandom(6).hex()}")
    block = F.struct(F.col("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("text").alias("block_type"), F.lit("text").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source"))
    pages = t.documents.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source"), F.lit(1).alias("page_num"), F.array(block).alias("text_blocks"))
    pages = pages.withColumns({f.name: F.lit(None).cast(f.dataType) for f in PAGES if f.name not in ("source", "page_num", "text_blocks")})
    for number in range(3):
        if number < 2:
            pages.where(F.col("doc_id") % 2 == number).select(*PAGES.fieldNames()).write.mode("append").parquet(f"{root}/pages")
        # one chunk per page, whatever its length
        ingest_stream(stream_parsed(t.spark, f"{root}/pages"), f"{root}/collection", f"{root}/checkpoint", size=1 << 30, overlap=0, minimum=0).awaitTermination()
    collection = ingest.load_collection(t.spark, f"{root}/collection")
    found = lexical.search(collection.index, asked(t), 20)
    return found.select("query_id", F.substring_index("id", "#", 1).cast("bigint").alias("id"), "score", "rank")


@register(
    "bm25_index_stats",
    f"""WITH tok AS (SELECT {tokens_sql('text')} AS tokens FROM documents),
    terms AS (SELECT DISTINCT unnest(tokens) AS term FROM tok)
    SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
      (SELECT count(*) FROM terms) AS n_terms FROM tok""",
)
def bm25_index_stats(t):
    index = lexical.build_index(t.documents, "doc_id")
    totals = index.lengths.agg(F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avgdl"), F.count("*").alias("n_docs"))
    n_terms = index.terms.select(F.count("*")).scalar()
    return totals.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens", n_terms.alias("n_terms"))


@register(
    "bm25_idf",
    f"""WITH tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, n""",
)
def bm25_idf(t):
    index = lexical.build_index(t.documents, "doc_id")
    return index.idf().select("term", "df", F.round("idf", 6).alias("idf"))


@register(
    "token_counts",
    f"""SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_terms
    FROM (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents)""",
)
def token_counts(t):
    tokens = t.documents.select("doc_id", tokenize("text").alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("n_terms"),
    )


@register(
    "tokens_cjk_fmm",
    f"""WITH {FILINGS_SQL} SELECT chunk_id,
    array_to_string(regexp_extract_all(text, '{TOKEN_REGEX.split('|', 2)[2]}'), ' ') AS segments,
    array_to_string({tokens_sql('text')}, ' ') AS tokens FROM filings""",
)
def tokens_cjk_fmm(t):
    return filings(t).select(
        "chunk_id",
        F.array_join(segment_cjk("text"), " ").alias("segments"),
        F.array_join(tokenize("text"), " ").alias("tokens"),
    )


@register(
    "finance_terms_match",
    f"""WITH {FILINGS_SQL} SELECT chunk_id, unnest(list_filter([{quoted(C.FINANCE_TERMS)}], lambda w: contains(text, w))) AS term
    FROM filings""",
)
def finance_terms_match(t):
    return each(filings(t), ["chunk_id"], finance_terms("text"), "term")


@register(
    "encode_hash",
    f"""WITH {hash_vectors_sql(DOCS_SQL, 'vec')}
    SELECT id AS doc_id, CAST(slot AS BIGINT) AS slot, round(w, 6) AS weight FROM vec_unit WHERE w <> 0""",
)
def encode_hash(t):
    parts = document_vectors(t).select("doc_id", F.posexplode("embedding").alias("slot", "w"))
    return parts.where("w <> 0").select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


@register("dense_topk", f"WITH {dense_sql(10, DOCS_SQL, ASKED_VECTOR_SQL)} SELECT query_id, id, score, rank FROM vrun")
def dense_topk_query(t):
    return vector_run(t, 10).select(*RUN)


@register(
    "dense_topk_embeddings",
    f"""WITH {LABEL_SQL} SELECT query_id, id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 20""",
)
def dense_topk_embeddings(t):
    return dense_topk(t.embeddings, label_queries(t), 20, id_col="vec_id").select(*RUN)


@register(
    "dense_topk_tie_high_id",
    f"""WITH {LABEL_SQL},
    signs AS (SELECT id, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS e FROM emb),
    sq AS (SELECT query_id, list_transform(q, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q FROM lq),
    s AS (SELECT query_id, id, round(list_inner_product(q, e) / 64, 6) AS score FROM sq, signs)
    SELECT query_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM s) WHERE rank <= 20""",
)
def dense_topk_tie_high_id(t):
    def signs(name):
        return F.transform(name, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0))).alias("embedding")

    stored = t.embeddings.select("vec_id", signs("embedding"))
    questions = label_queries(t).select("query_id", signs("embedding"))
    return dense_topk(stored, questions, 20, id_col="vec_id", high_id_first=True).select(*RUN)


_IVF_SQL = f"""{LABEL_SQL},
assigned AS (SELECT id, query_id AS list_no FROM (
  SELECT id, query_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) AS r FROM sim) WHERE r = 1),
cent AS (SELECT a.query_id, b.query_id AS list_no,
  round(list_inner_product(a.q, b.q) / (sqrt(list_inner_product(a.q, a.q)) * sqrt(list_inner_product(b.q, b.q))), 6) AS score
  FROM lq a, lq b),
probe AS (SELECT query_id, list_no FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_no) AS r FROM cent) WHERE r <= 3),
ivf AS (SELECT query_id, id, score, rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM probe JOIN assigned USING (list_no) JOIN sim USING (query_id, id)) WHERE rank <= 20),
flat AS (SELECT query_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 20)"""


def _ivf(t, k=20, n_probe=3, stored=False):
    questions = label_queries(t)
    centroids = questions.select(F.col("query_id").cast("int").alias("list_no"), "embedding")
    lists = assign_lists(t.embeddings.select("vec_id", "embedding"), centroids)
    if stored:
        path = os.path.join(shared_dir(t.spark), f"lists-{os.urandom(6).hex()}")
        write_vectors(lists, path, "list_no")
        lists = read_vectors(t.spark, path)
    return probed_topk(lists, questions, centroids, k, n_probe, id_col="vec_id")


@register("dense_ivf_topk", f"WITH {_IVF_SQL} SELECT query_id, id, score, rank FROM ivf")
def dense_ivf_topk(t):
    return _ivf(t).select(*RUN)


@register("dense_ivf_stored", f"WITH {_IVF_SQL} SELECT query_id, id, score, rank FROM ivf")
def dense_ivf_stored(t):
    """As ``dense_ivf_topk`` over vectors stored in a folder per list; unprobed folders are not read."""
    return _ivf(t, stored=True).select(*RUN)


@register(
    "ann_recall",
    f"""WITH {_IVF_SQL} SELECT (SELECT count(*) FROM flat JOIN ivf USING (query_id, id)) AS n_found,
    round((SELECT count(*) FROM flat JOIN ivf USING (query_id, id)) / (SELECT count(*) FROM flat), 6) AS recall""",
)
def ann_recall_query(t):
    exact = dense_topk(t.embeddings, label_queries(t), 20, id_col="vec_id")
    return ann_recall(exact, _ivf(t))


# --- fusion -----------------------------------------------------------------------------------


def _rrf_sql(k, vw, bw, depth=20):
    return f"""WITH {runs_sql(depth)},
    f AS (SELECT query_id, id, v.rank AS v_rank, b.rank AS b_rank, v.score AS v_score, b.score AS b_score,
      round(coalesce({vw} / ({k} + v.rank), 0) + coalesce({bw} / ({k} + b.rank), 0), 9) AS rrf_score
      FROM vrun v FULL OUTER JOIN brun b USING (query_id, id)),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY rrf_score DESC, v_rank ASC NULLS LAST, b_rank ASC NULLS LAST) AS rank FROM f)"""


@register(
    "rrf_fusion", _rrf_sql(60, 1.0, 1.0) + " SELECT query_id, id, rrf_score, v_rank, b_rank, rank FROM fused"
)
def rrf_fusion(t):
    return fusion.rrf(vector_run(t, 20), lexical_run(t, 20))


@register(
    "rrf_weighted", _rrf_sql(40, 0.6, 0.4) + " SELECT query_id, id, rrf_score, v_rank, b_rank, rank FROM fused"
)
def rrf_weighted(t):
    return fusion.rrf(vector_run(t, 20), lexical_run(t, 20), C.RRF_K_EVAL, 0.6, 0.4)


_CONCAT_SQL = f"""WITH {runs_sql(20)},
u AS (SELECT query_id, id, 0 AS side, score, rank AS side_rank FROM vrun
  UNION ALL SELECT query_id, id, 1, score, rank FROM brun),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY side, side_rank) AS r FROM u) WHERE r = 1),
merged AS (SELECT query_id, id, CAST(side AS BIGINT) AS side, score,
  row_number() OVER (PARTITION BY query_id ORDER BY side, side_rank) AS rank FROM one)"""


@register("concat_dedupe", _CONCAT_SQL + " SELECT query_id, id, side, score, rank FROM merged")
def concat_dedupe(t):
    merged = fusion.concat_dedupe(vector_run(t, 20), lexical_run(t, 20))
    return merged.select("query_id", "id", F.col("side").cast("bigint").alias("side"), "score", "rank")


@register(
    "filter_with_fallback",
    _CONCAT_SQL
    + """, flagged AS (SELECT m.*, source, source = 'src' || CAST(query_id % 20 AS VARCHAR) AS keep
      FROM merged m JOIN documents ON id = doc_id),
    has AS (SELECT query_id, bool_or(keep) AS has FROM flagged GROUP BY 1)
    SELECT query_id, id, source, rank FROM flagged JOIN has USING (query_id) WHERE keep OR NOT has""",
)
def filter_with_fallback(t):
    merged = fusion.concat_dedupe(vector_run(t, 20), lexical_run(t, 20))
    hits = merged.join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    wanted = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    kept = fusion.filter_with_fallback(hits, F.col("source") == wanted)
    return kept.select("query_id", "id", "source", "rank")


@register(
    "hybrid_search",
    _rrf_sql(60, 1.0, 1.0)
    + """, sides AS (SELECT query_id, count(v_rank) AS nv, count(b_rank) AS nb FROM fused GROUP BY 1)
    SELECT query_id, id, CASE WHEN nb = 0 THEN v_score WHEN nv = 0 THEN b_score ELSE rrf_score END AS score, rank
    FROM fused JOIN sides USING (query_id) WHERE rank <= 10""",
)
def hybrid_search(t):
    return fusion.hybrid(vector_run(t, 20), lexical_run(t, 20), limit=10).select(*RUN)


@register(
    "overlap_partition",
    f"""WITH {runs_sql(50)}, {JUDGED_SQL}
    SELECT query_id, id, CASE WHEN v.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both'
      WHEN v.rank IS NOT NULL THEN 'vector_only' WHEN b.rank IS NOT NULL THEN 'lexical_only' ELSE 'neither' END AS found
    FROM judged LEFT JOIN vrun v USING (query_id, id) LEFT JOIN brun b USING (query_id, id)""",
)
def overlap_partition(t):
    return fusion.overlap_partition(vector_run(t, 50), lexical_run(t, 50), judged(t))


# --- reranking --------------------------------------------------------------------------------


def _wordset(text):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))"


@register(
    "wordset_overlap_rerank",
    f"""WITH {bm25_sql(30, DOCS_SQL, ASKED_SQL)},
    s AS (SELECT query_id, id, brun.rank AS old, round(len(list_intersect({_wordset('b.text')}, {_wordset('d.text')}))
      / (len({_wordset('b.text')}) + 1), 9) AS rerank_score
      FROM brun JOIN benchmark b ON query_id = item_id JOIN documents d ON id = doc_id)
    SELECT query_id, id, rerank_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM s) WHERE rank <= 5""",
)
def wordset_overlap_rerank(t):
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    hits = lookup(lexical_run(t, 30), texts, "id").join(asked(t), "query_id")
    return overlap_rerank(hits).select("query_id", "id", "rerank_score", "rank")


@register(
    "hybrid_rerank",
    _rrf_sql(60, 1.0, 1.0)
    + f""", listed AS (SELECT query_id, id, rank FROM fused WHERE rank <= query_id % 8 + 2),
    n AS (SELECT query_id, count(*) > 5 AS long FROM listed GROUP BY 1),
    s AS (SELECT query_id, id, listed.rank AS old, CASE WHEN long THEN round(len(list_intersect({_wordset('b.text')}, {_wordset('d.text')}))
      / (len({_wordset('b.text')}) + 1), 9) END AS rerank_score
      FROM listed JOIN n USING (query_id) JOIN benchmark b ON query_id = item_id JOIN documents d ON id = doc_id)
    SELECT query_id, id, rerank_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, old) AS rank FROM s) WHERE rank <= 5""",
)
def hybrid_rerank(t):
    """Fused lists of two to nine hits; only those of more than five are reranked."""
    listed = fusion.hybrid(vector_run(t, 20), lexical_run(t, 20)).where(F.col("rank") <= F.col("query_id") % 8 + 2)
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    hits = lookup(listed.select("query_id", "id", "rank"), texts, "id").join(asked(t), "query_id")
    return rerank_longer(hits, F.round(overlap_score("query", "text"), 9)).select("query_id", "id", "rerank_score", "rank")


@register(
    "rerank_cut", f"WITH {bm25_sql(30, DOCS_SQL, ASKED_SQL)} SELECT query_id, id, rank FROM brun WHERE rank <= 5"
)
def rerank_cut(t):
    return cut(lexical_run(t, 30)).select("query_id", "id", "rank")


@register(
    "document_lookup",
    f"""WITH {bm25_sql(5, DOCS_SQL, ASKED_SQL)}
    SELECT query_id, id, rank, source, lang, length(text) AS n_chars FROM brun LEFT JOIN documents ON id = doc_id""",
)
def document_lookup(t):
    documents = t.raw("documents").select(F.col("doc_id").alias("id"), "source", "lang", F.length("text").cast("bigint").alias("n_chars"))
    return lookup(lexical_run(t, 5), documents, "id").select("query_id", "id", "rank", "source", "lang", "n_chars")


# --- recall recovery --------------------------------------------------------------------------


def _variant_list(query):
    parts = [query]
    for term, others in C.RECOVERY_SYNONYMS.items():
        parts += [f"CASE WHEN contains({query}, '{term}') THEN replace({query}, '{term}', '{o}') END" for o in others]
    return f"[{', '.join(parts)}]"


_RECOVERY_ASKED = "SELECT DISTINCT indicator AS query_id, indicator AS query FROM filings"


@register(
    "empty_recall_recovery",
    f"""WITH {FILINGS_SQL},
    {bm25_sql(10, 'SELECT chunk_id AS id, text FROM filings', _RECOVERY_ASKED, 'base')},
    miss AS (SELECT * FROM ({_RECOVERY_ASKED}) WHERE query_id NOT IN (SELECT query_id FROM base)),
    lists AS (SELECT query_id, list_filter({_variant_list('query')}, lambda v: v IS NOT NULL) AS vs FROM miss),
    variants AS (SELECT query_id, query, min(n) AS n FROM (
      SELECT query_id, unnest(vs) AS query, generate_subscripts(vs, 1) AS n FROM lists) GROUP BY 1, 2),
    {bm25_sql(10, 'SELECT chunk_id AS id, text FROM filings', "SELECT query_id || '|' || n AS query_id, query FROM variants", 'var')},
    seen AS (SELECT v.query_id, id, score, n, var.rank AS vr FROM variants v JOIN var ON var.query_id = v.query_id || '|' || n),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY n, vr) AS r FROM seen) WHERE r = 1),
    merged AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY n, vr) AS rank FROM one)
    SELECT query_id, id, score, rank, false AS recovered FROM base
    UNION ALL SELECT query_id, id, score, rank, true FROM merged WHERE rank <= 10""",
)
def empty_recall_recovery(t):
    data = filings(t)
    questions = data.select(F.col("indicator").alias("query_id"), F.col("indicator").alias("query")).distinct()
    return qa.recover_empty(data, questions).select(*RUN, "recovered")
