"""Badcase log and Markdown reports. Spark aggregates, the driver only renders the few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators.ranking import first_n


def badcase_counts(cases: DataFrame, type_col: str = "case_type") -> DataFrame:
    """Number and share in percent per case type."""
    counted = cases.groupBy(type_col).agg(F.count("*").alias("n_cases"))
    total = counted.select(F.sum("n_cases")).scalar()
    return counted.withColumn("share", F.round(F.col("n_cases") * 100 / total, 1))


def badcase_examples(
    cases: DataFrame, type_col: str = "case_type", order_col: str = "case_id", n: int = 3,
    types: list[str] | None = None,
) -> DataFrame:
    """First ``n`` cases of every reported type."""
    chosen = cases.where(F.col(type_col).isin(types or C.BADCASE_TYPES))
    return first_n(chosen, [type_col], [F.asc(order_col)], n)


def irrelevant(score: Column) -> Column:
    """Best scores below the limit, or none at all."""
    return F.coalesce(score < C.IRRELEVANT_SCORE, F.lit(True))


def slow(milliseconds: Column) -> Column:
    return milliseconds > C.LATENCY_LIMIT_MS


def serve_slow(calls: DataFrame, key: str, entry: str, ms: str = "ms") -> DataFrame:
    """Slow calls with ``outcome``: ``cached`` if the key has a fast entry, else ``badcase``."""
    cached = calls.where(~slow(F.col(ms))).groupBy(key).agg(F.max(entry).alias("_cached"))
    outcome = F.when(F.col("_cached").isNotNull(), "cached").otherwise("badcase")
    return calls.where(slow(F.col(ms))).join(cached, key, "left").withColumn("outcome", outcome).drop("_cached")


def flag_badcases(answers: DataFrame) -> DataFrame:
    """Case log from ``query_id, query, answer, max_score, is_hallucination, latency_ms``.

    One row per case; a question may produce several.
    """
    checks = F.array(
        F.when(F.col("max_score").isNull(), F.lit("empty_recall")),
        F.when(F.coalesce(F.col("max_score"), F.lit(0.0)) < C.IRRELEVANT_SCORE, F.lit("irrelevant_answer")),
        F.when(F.col("is_hallucination"), F.lit("hallucination")),
        F.when(slow(F.col("latency_ms")), F.lit("high_latency")),
    )
    return answers.select(
        "query_id", "query", "answer", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("case_type")
    ).withColumn("case_id", F.concat_ws("-", F.col("query_id").cast("string"), "case_type"))


def markdown_table(df: DataFrame) -> str:
    """A result as a Markdown table, all its rows in order."""
    rows = df.toLocalIterator()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows]
    return "\n".join(lines)


def badcase_report(cases: DataFrame) -> str:
    """Counts, then example cases of each type."""
    counts = badcase_counts(cases).orderBy(F.desc("n_cases"), "case_type")
    examples = badcase_examples(cases).orderBy("case_type", "place").collect()
    parts = ["# Badcases", "", "## Counts", "", markdown_table(counts), "", "## Examples", ""]
    for row in examples:
        parts.append(f"- **{row['case_type']}**: {row['query']}")
    return "\n".join(parts) + "\n"


def experiment_report(grid: DataFrame) -> str:
    """Chunk experiment table, by size and overlap."""
    ordered = grid.orderBy("chunk_size", "overlap")
    return "\n".join(["# Chunk settings", "", markdown_table(ordered), ""])
