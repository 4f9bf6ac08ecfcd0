"""Rows from arrays, and spreading inputs over all cores or over tasks of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list[str | Column], array: Column | str, name: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer test the size of the array first, which evaluates an
    expensive array expression twice; the outer form with a NULL test does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def each_struct(df: DataFrame, keep: list[str | Column], array: Column, present: str) -> DataFrame:
    """One row per struct with its fields as columns; ``present`` names a field that is never NULL."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Repartition inputs with fewer splits than cores, such as one small unsplittable file.

    Large inputs have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_for(df: DataFrame, amount: float, each_part: int, most: int = 1 << 13) -> int:
    """Number of partitions that hold about ``each_part`` of ``amount`` each; at least one per core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(most, math.ceil(amount / each_part)))
