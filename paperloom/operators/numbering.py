"""Consecutive numbers within groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import fits_broadcast, write_through

ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def group_key(column: Column) -> Column:
    """A string key that is never NULL and orders like the column: NULL first, then by UTF-8 bytes."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` within ``group``) and ``total`` (rows of the group).

    Rows are cut into ranges of (group, order) and written in that order; the place of a row in its range plus
    the rows of the group in the ranges before it is its number. So a group may be of any size: no task
    holds more than its range, and what is summed up is one row per range and group. Equal rows are told
    apart by their place in the input, so that they too can be cut. ``group`` must not be NULL.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = write_through(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    counts = placed.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = write_through(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total")), "offsets")
    joined = placed.withColumn("_part", part).join(small(offsets), [group, "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
