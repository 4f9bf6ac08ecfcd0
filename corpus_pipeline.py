"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, folder) and works on all rows that the one before it kept. All but
the last return the columns of ``documents``. The rows of a stage are written before the next one starts, which
then deletes what the one before has left in the shared folder. Cases such as NULL or empty texts are those of the
operators; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.decontam import drop_contaminated
from paperloom.llm.language import keep_known
from paperloom.llm.pieces import MODEL, coder, vocabulary_path
from paperloom.llm.pii import redact
from paperloom.llm.simhash import near_dedup
from paperloom.session import sweep, write_through


def keep_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which at least half is in one learned language; NULL labels are filled with it."""
    sweep(spark)
    return keep_known(docs, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, likeness of 0.8 or more."""
    sweep(spark)
    return near_dedup(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    sweep(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    sweep(spark)
    return redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of every text, and the text as decoded from them."""
    sweep(spark)
    coded = docs.select("doc_id", "lang", "source", "n_chars", coder(vocabulary_path(MODEL))(F.col("text")).alias("coded"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("coded.n").alias("n_pieces"),
        F.col("coded.crc32").alias("ids_crc32"),
        F.col("coded.ids").alias("ids"),
        F.col("coded.text").alias("text"),
    )


STAGES = [
    ("language", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("pieces", encode_pieces),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
