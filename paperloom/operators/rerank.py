"""Reordering of bounded candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.tokens import word_set
from paperloom.operators.ranking import ranked


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Shared words over query words plus one."""
    wanted = word_set(query)
    return F.size(F.array_intersect(wanted, word_set(text))) / (F.size(wanted) + 1)


def rerank(
    candidates: DataFrame, score: Column, k: int = C.CHAIN_RERANK_TOP_K, query_id: str = "query_id"
) -> DataFrame:
    """Best ``k`` candidates per query by a new score; retrieval order decides ties.

    Replaces ``rank`` and adds ``rerank_score``.
    """
    scored = candidates.withColumn("rerank_score", score).withColumnRenamed("rank", "_old")
    order = [F.desc("rerank_score"), F.asc("_old")]
    return ranked(scored, [query_id], order).where(F.col("rank") <= k).drop("_old")


def rerank_longer(
    candidates: DataFrame, score: Column, k: int = C.CHAIN_RERANK_TOP_K, query_id: str = "query_id"
) -> DataFrame:
    """Best ``k`` candidates per query; only lists of more than ``k`` are reordered.

    The lists are bounded by what retrieval returned, so their lengths may be windowed.
    """
    long = F.count("*").over(Window.partitionBy(query_id)) > k
    scored = candidates.withColumn("_long", long).withColumn("rerank_score", F.when(F.col("_long"), score)).withColumnRenamed("rank", "_old")
    order = [F.desc("rerank_score"), F.asc("_old")]
    return ranked(scored, [query_id], order).where(F.col("rank") <= k).drop("_old", "_long")


def overlap_rerank(
    candidates: DataFrame, k: int = C.CHAIN_RERANK_TOP_K, query: str = "query", text: str = "text"
) -> DataFrame:
    return rerank(candidates, F.round(overlap_score(query, text), 9), k)


def cut(candidates: DataFrame, k: int = C.CHAIN_RERANK_TOP_K) -> DataFrame:
    """Without a reranker the first ``k`` hits stand."""
    return candidates.where(F.col("rank") <= k)
