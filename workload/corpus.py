"""Corpus administration: duplicates, pending work, counts and samples."""

import os

from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators import matching as M
from paperloom.operators.ranking import keep_first
from paperloom.session import shared_dir
from paperloom.streaming.ingest import ingest_available, stream_parsed
from workload.base import FILINGS_SQL, filings, register


@register("dedupe_keep_first", "SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_keep_first(t):
    """First document per text; the digest stands for the text, so texts are not shuffled."""
    keyed = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return keep_first(keyed, ["key"], [F.asc("doc_id")]).select("key", "doc_id")


@register(
    "dedupe_samples",
    f"""WITH {FILINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company, indicator, unit ORDER BY chunk_id) AS r FROM filings)
    SELECT company, indicator, unit, chunk_id FROM r WHERE r = 1""",
)
def dedupe_samples(t):
    first = keep_first(filings(t), ["company", "indicator", "unit"], [F.asc("chunk_id")])
    return first.select("company", "indicator", "unit", "chunk_id")


@register("pending_files", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_files(t):
    return M.pending(t.raw("documents").select("doc_id", "source"), t.labels, "doc_id")


@register(
    "labelled_hits", "SELECT source, count(*) AS n_docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1"
)
def labelled_hits(t):
    good = t.labels.where("quality = 1").select("doc_id")
    return t.raw("documents").select("doc_id", "source").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n_docs"))


@register(
    "group_counts",
    f"WITH {FILINGS_SQL} SELECT industry, indicator, count(*) AS n FROM filings GROUP BY GROUPING SETS ((industry), (indicator), (industry, indicator))",
)
def group_counts(t):
    data = filings(t).select("industry", "indicator")
    sets = [["industry"], ["indicator"], ["industry", "indicator"]]
    return data.groupingSets(sets, "industry", "indicator").agg(F.count("*").alias("n"))


@register(
    "top_companies",
    f"WITH {FILINGS_SQL} SELECT company, count(*) AS n FROM filings WHERE source NOT LIKE 'H3\\_%' ESCAPE '\\' GROUP BY 1 ORDER BY n DESC, company LIMIT 20",
)
def top_companies(t):
    kept = filings(t).where(~F.col("source").startswith(C.EXCLUDED_SOURCE_PREFIX))
    return kept.groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(20)


@register(
    "file_name_counts",
    f"""WITH {FILINGS_SQL}, p AS (SELECT string_split(replace(source, '.pdf', ''), '_') AS p FROM filings)
    SELECT p[1] AS industry, p[3] AS third, p[4] AS fourth, count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def file_name_counts(t):
    parts = F.split(F.replace("source", F.lit(".pdf"), F.lit("")), "_")
    named = filings(t).select(parts.alias("p"))
    return named.groupBy(
        F.get("p", F.lit(0)).alias("industry"), F.get("p", F.lit(2)).alias("third"), F.get("p", F.lit(3)).alias("fourth")
    ).agg(F.count("*").alias("n"))


@register(
    "sample_seeded", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 80"
)
def sample_seeded(t):
    return M.sample_seeded(t.raw("documents").select("doc_id", "source"), "doc_id", 80)


@register(
    "sample_split",
    """WITH p AS (SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM documents)
    SELECT CASE WHEN p < 0.5 THEN 'fact' WHEN p < 0.8 THEN 'comparison' ELSE 'summary' END AS split, count(*) AS n FROM p GROUP BY 1""",
)
def sample_split(t):
    labelled = M.split_by_share(t.raw("documents").select("doc_id"), "doc_id", [("fact", 0.5), ("comparison", 0.3), ("summary", 0.2)])
    return labelled.groupBy("split").agg(F.count("*").alias("n"))


@register(
    "incremental_ingest",
    "SELECT doc_id % 2 AS round, count(*) AS n_pages FROM documents GROUP BY 1 UNION ALL SELECT 2, 0",
)
def incremental_ingest(t):
    """Two arrivals and a run without news through the checkpointed stream; pages per run."""
    root = os.path.join(shared_dir(t.spark), f"ingest-{os.urandom(6).hex()}")
    pages = t.documents.select(
        F.col("doc_id").cast("string").alias("source"),
        F.lit(1).alias("page_num"),
        F.array(
            F.struct(
                F.col("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("text").alias("block_type"),
                F.lit("text").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source"),
            )
        ).alias("text_blocks"),
        F.array().cast(
            "array<struct<data:array<array<string>>,markdown:string,bbox:array<double>,headers:array<string>,row_count:int,col_count:int>>"
        ).alias("tables"),
        F.lit(None).cast("double").alias("width"),
        F.lit(None).cast("double").alias("height"),
        (F.col("doc_id") % 2).alias("round"),
    )
    for number in range(3):
        if number < 2:
            pages.where(F.col("round") == number).drop("round").write.mode("append").parquet(f"{root}/pages")
        query = ingest_available(
            stream_parsed(t.spark, f"{root}/pages"), f"{root}/chunks", f"{root}/vectors", f"{root}/checkpoint", overlap=100
        )
        query.awaitTermination()
    stored = t.spark.read.parquet(f"{root}/chunks").groupBy("batch").agg(F.count_distinct("source").alias("n_pages"))
    runs = t.spark.range(3).withColumnRenamed("id", "round")
    joined = runs.join(stored, runs["round"] == stored["batch"], "left")
    return joined.select("round", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
