"""Combining and filtering ranked lists. Runs have ``query_id, id, score, rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.questions import company_in_query, file_suffix_in_query
from paperloom.operators.ranking import ranked


def _paired(vector_run: DataFrame, lexical_run: DataFrame) -> DataFrame:
    v = vector_run.select("query_id", "id", F.col("rank").alias("v_rank"), F.col("score").alias("v_score"))
    b = lexical_run.select("query_id", "id", F.col("rank").alias("b_rank"), F.col("score").alias("b_score"))
    return v.join(b, ["query_id", "id"], "full_outer")


def _fuse(
    vector_run: DataFrame, lexical_run: DataFrame, k: int, vector_weight: float, lexical_weight: float
) -> DataFrame:
    def part(name: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(k) + F.col(name)), F.lit(0.0))

    fused = _paired(vector_run, lexical_run).withColumn(
        "rrf_score", F.round(part("v_rank", vector_weight) + part("b_rank", lexical_weight), 9)
    )
    order = [F.desc("rrf_score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank")]
    return ranked(fused, ["query_id"], order)


def rrf(
    vector_run: DataFrame,
    lexical_run: DataFrame,
    k: int = C.RRF_K,
    vector_weight: float = 1.0,
    lexical_weight: float = 1.0,
) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, id, rrf_score, v_rank, b_rank, rank``.

    Equal scores keep vector hits first, in vector order, then lexical-only hits in theirs.
    """
    fused = _fuse(vector_run, lexical_run, k, vector_weight, lexical_weight)
    return fused.select("query_id", "id", "rrf_score", "v_rank", "b_rank", "rank")


def concat_dedupe(vector_run: DataFrame, lexical_run: DataFrame) -> DataFrame:
    """Vector hits, then lexical hits not among them: ``query_id, id, side, score, rank``."""
    pairs = _paired(vector_run, lexical_run)
    merged = pairs.select(
        "query_id",
        "id",
        F.when(F.col("v_rank").isNotNull(), 0).otherwise(1).alias("side"),
        F.coalesce("v_score", "b_score").alias("score"),
        F.coalesce("v_rank", "b_rank").alias("side_rank"),
    )
    return ranked(merged, ["query_id"], [F.col("side"), F.col("side_rank")]).drop("side_rank")


def merge_by_score(vector_run: DataFrame, lexical_run: DataFrame) -> DataFrame:
    """Both lists without repeats in order of score; equal scores keep the order of concatenation."""
    merged = concat_dedupe(vector_run, lexical_run).withColumnRenamed("rank", "place")
    return ranked(merged, ["query_id"], [F.desc("score"), F.col("place")]).drop("place")


def hybrid(
    vector_run: DataFrame, lexical_run: DataFrame, k: int = C.RRF_K, limit: int | None = None
) -> DataFrame:
    """Fused run; a query with hits on one side only keeps that side's scores and order.

    The side counts ride on the partitioning of the rank, both lists being bounded.
    """
    per_query = Window.partitionBy("query_id")
    fused = _fuse(vector_run, lexical_run, k, 1.0, 1.0)
    score = (
        F.when(F.count("b_rank").over(per_query) == 0, F.col("v_score"))
        .when(F.count("v_rank").over(per_query) == 0, F.col("b_score"))
        .otherwise(F.col("rrf_score"))
    )
    run = fused.select("query_id", "id", score.alias("score"), "rrf_score", "rank")
    return run if limit is None else run.where(F.col("rank") <= limit)


def filter_with_fallback(hits: DataFrame, keep: Column, query_id: str = "query_id") -> DataFrame:
    """Keep the rows that satisfy ``keep``, or all rows of queries where none does.

    The counts are aggregated and joined back rather than windowed, so one query's rows need
    not fit a task.
    """
    flagged = hits.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    any_kept = flagged.groupBy(query_id).agg(F.max("_keep").alias("_any"))
    return (
        flagged.join(any_kept, query_id).where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")
    )


def filter_by_company(
    hits: DataFrame, question: str = "query", source: str = "source", query_id: str = "query_id",
    compat: bool = False,
) -> DataFrame:
    """Keep hits from the company (and file) a question names, all hits if there are none."""
    company = company_in_query(question)
    suffix = file_suffix_in_query(question, compat)
    src = F.col(source)
    from_file = F.when(suffix == "", True).when(F.lit(compat), F.contains(src, suffix)).otherwise(
        F.concat(F.lit("_"), F.replace(src, F.lit(".pdf"), F.lit("")), F.lit("_")).contains(
            F.concat(F.lit("_"), suffix, F.lit("_"))
        )
    )
    keep = (company == "") | (F.contains(src, company) & from_file)
    return filter_with_fallback(hits, keep, query_id)


def overlap_partition(vector_run: DataFrame, lexical_run: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each target was found: ``query_id, id, found`` in both, vector, lexical, neither."""
    v = vector_run.select("query_id", "id", F.lit(True).alias("in_v"))
    b = lexical_run.select("query_id", "id", F.lit(True).alias("in_b"))
    joined = targets.join(v, ["query_id", "id"], "left").join(b, ["query_id", "id"], "left")
    found = (
        F.when(F.col("in_v") & F.col("in_b"), "both")
        .when(F.col("in_v"), "vector_only")
        .when(F.col("in_b"), "lexical_only")
        .otherwise("neither")
    )
    return joined.select("query_id", "id", found.alias("found"))
