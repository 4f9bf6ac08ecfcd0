"""Ranks, top-k and keep-first. Every order is total, so results do not depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint"))


def top_k(df: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """Best ``k`` rows per query by score, smaller id first among equals.

    The rank filter becomes a per-partition limit before the shuffle, so a query that matches
    a third of the collection still moves only ``k`` rows per task.
    """
    order = [F.desc("score"), F.asc(id_col)]
    return ranked(df, [query_id], order).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order; copies are dropped before the shuffle."""
    return ranked(df, keys, order, "_place").where("_place = 1").drop("_place")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return ranked(df, keys, order, "place").where(F.col("place") <= n)
