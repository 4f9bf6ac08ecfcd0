"""What writers store, readers give back: counts and digests of whole tables after a round trip."""

import os

from pyspark.sql import functions as F

from paperloom.session import shared_dir
from paperloom.sources import readers, writers
from workload.base import register


def _folder(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), f"{name}-{os.urandom(6).hex()}")


def _digest(text):
    return F.md5(F.col(text).cast("binary"))


@register(
    "pages_roundtrip",
    "SELECT source, CAST(doc_id AS INTEGER) AS page_num, len(string_split(text, chr(10))) AS n_blocks, md5(text) AS digest FROM documents",
)
def pages_roundtrip(t):
    """Documents as pages of one block per line, stored as JSON lines."""
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit("text").alias("block_type")))
    pages = t.raw("documents").select("source", F.col("doc_id").cast("int").alias("page_num"), blocks.alias("text_blocks"))
    path = _folder(t, "pages")
    writers.write_pages(pages, path)
    text = F.array_join(F.transform("text_blocks", lambda b: b["text"]), "\n")
    back = readers.read_parsed(t.spark, path).withColumn("text", text)
    return back.select("source", "page_num", F.size("text_blocks").cast("bigint").alias("n_blocks"), _digest("text").alias("digest"))


@register(
    "chunks_roundtrip",
    """SELECT source || '#' || doc_id AS chunk_id, source, CAST(doc_id % 7 AS INTEGER) AS page_num, 'text' AS chunk_type,
    doc_id % 2 = 0 AS has_table, md5(text) AS digest FROM documents""",
)
def chunks_roundtrip(t):
    chunks = t.raw("documents").select(
        F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("chunk_id"),
        "text",
        "source",
        (F.col("doc_id") % 7).alias("page_num"),
        F.lit("text").alias("chunk_type"),
        (F.col("doc_id") % 2 == 0).alias("has_table"),
    )
    path = _folder(t, "chunks")
    writers.write_chunks(chunks, path)
    back = readers.read_chunks(t.spark, path)
    return back.select("chunk_id", "source", "page_num", "chunk_type", "has_table", _digest("text").alias("digest"))


@register(
    "eval_roundtrip",
    """SELECT CAST(item_id AS VARCHAR) AS query_id, md5(text) AS digest, CASE WHEN length(text) % 2 = 0 THEN 'fact' ELSE 'summary' END AS query_type,
    unnest(['c' || item_id, 'c' || (item_id + 1)]) AS id FROM benchmark""",
)
def eval_roundtrip(t):
    ids = F.array(F.concat(F.lit("c"), "item_id"), F.concat(F.lit("c"), F.col("item_id") + 1))
    kind = F.when(F.length("text") % 2 == 0, "fact").otherwise("summary")
    samples = t.raw("benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), kind.alias("query_type"), ids.alias("ground_truth_doc_ids")
    )
    path = _folder(t, "samples")
    writers.write_eval_set(samples, path)
    back, judged = readers.read_eval_set(t.spark, path)
    return back.select("query_id", _digest("query").alias("digest"), "query_type").join(judged, "query_id")


@register(
    "vectors_roundtrip",
    """SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings""",
)
def vectors_roundtrip(t):
    """Vectors stored in folders by label."""
    path = _folder(t, "vectors")
    writers.write_vectors(t.raw("embeddings"), path, "label")
    ends = [F.round(F.element_at("embedding", i).cast("double"), 6).alias(n) for i, n in ((1, "first"), (-1, "last"))]
    return readers.read_vectors(t.spark, path).select("vec_id", "label", *ends)


@register("csv_roundtrip", "SELECT doc_id, source, md5(text) AS digest FROM documents")
def csv_roundtrip(t):
    """Texts with line breaks, quotes and separators in CSV."""
    path = _folder(t, "csv")
    writers.write_csv(t.raw("documents").select("doc_id", "source", "text"), path)
    back = readers.read_csv(t.spark, path, "doc_id bigint, source string, text string")
    return back.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


class LineExtractor:
    """A page per line; refuses files with a table sign."""

    def pages(self, name, content):
        text = bytes(content).decode()
        if "|" in text:
            raise ValueError("table")
        for number, line in enumerate(text.split("\n")):
            yield {"page_num": number + 1, "text_blocks": [{"text": line, "block_type": "text"}], "tables": []}


@register(
    "ingest_rejects",
    """SELECT 'd' || doc_id || '.pdf' AS source, CASE WHEN contains(text, '|') THEN 'ValueError: table' END AS error,
    CASE WHEN contains(text, '|') THEN 0 ELSE len(string_split(text, chr(10))) END AS n_pages FROM documents""",
)
def ingest_rejects(t):
    """Every document as a file: pages of those that can be parsed, the error of the others."""
    name = F.concat(F.lit("d"), "doc_id", F.lit(".pdf"))
    files = t.raw("documents").select(name.alias("source"), name.alias("path"), F.col("text").cast("binary").alias("content"))
    found = readers.try_extract_pages(files, LineExtractor())
    return found.groupBy("source", "error").agg(F.count("page_num").alias("n_pages"))
