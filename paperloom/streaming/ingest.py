"""Incremental ingestion: a file stream with a checkpoint instead of a list of done files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom import constants as C
from paperloom import schemas as S
from paperloom.models import Encoder, HashEncoder, encode_table
from paperloom.functions.strings import strip
from paperloom.operators.chunking import chunk_pages, sentence_windows
from paperloom.operators.rows import each_struct
from paperloom.plans.ingest import append_pages


def stream_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Stream of pages stored as Parquet under ``path``; new files are picked up once."""
    return spark.readStream.schema(S.PAGES).parquet(path)


def ingest_available(
    pages: DataFrame,
    chunks_path: str,
    vectors_path: str,
    checkpoint: str,
    encoder: Encoder | None = None,
    size: int = C.CHUNK_SIZE,
    overlap: int = 50,
    minimum: int = C.CHUNK_MIN,
) -> StreamingQuery:
    """Process what has arrived since the last run, then stop.

    Each batch goes into folders named after its number and replaces them when it is replayed
    after a failure, so chunks and vectors appear exactly once.
    """
    model = encoder or HashEncoder()

    def save(batch: DataFrame, number: int) -> None:
        target = f"{chunks_path}/batch={number}"
        chunk_pages(batch, size, overlap, minimum).write.mode("overwrite").parquet(target)
        stored = batch.sparkSession.read.parquet(target)
        encode_table(stored, model).write.mode("overwrite").parquet(f"{vectors_path}/batch={number}")

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    encoder: Encoder | None = None,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    minimum: int = C.CHUNK_MIN,
) -> StreamingQuery:
    """Add the pages that have arrived to the collection under ``out``: chunks, vectors, postings and statistics.

    Each batch is one committed version of the collection, named after the checkpoint and its number, so a
    replayed batch is not added twice and readers never see a part of one.
    """
    model = encoder or HashEncoder()

    def save(batch: DataFrame, number: int) -> None:
        append_pages(batch, out, model, size, overlap, minimum, mark=f"{checkpoint}#{number}")

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def chunk_texts(
    texts: DataFrame, id_col: str, text_col: str = "text", size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP, minimum: int = C.CHUNK_MIN,
) -> DataFrame:
    """Sentence chunks of plain texts, ``<id>, ord, text``; works on batches and streams alike."""
    cut = texts.select(id_col, text_col, sentence_windows(text_col, size, overlap, minimum).alias("spans"))
    pieces = F.transform(
        "spans",
        lambda s, i: F.struct(
            i.alias("ord"), strip(F.substring(F.col(text_col), s["s"] + 1, s["e"] - s["s"])).alias("text")
        ),
    )
    kept = F.filter(pieces, lambda p: (F.length(p["text"]) >= minimum) | (p["ord"] == 0))
    return each_struct(cut, [id_col], kept, "ord")
