"""Ablations: chunk settings, retrieval methods, index kinds."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import strip
from paperloom.operators import evaluation as E
from paperloom.operators.chunking import sentence_windows
from paperloom.operators.rows import each, each_struct


def chunk_grid(
    texts: DataFrame,
    sizes: list[int] | None = None,
    overlaps: list[int] | None = None,
    minimum: int = C.CHUNK_MIN,
    text_col: str = "text",
) -> DataFrame:
    """Chunk statistics for every size and overlap: one scan, all settings in each row.

    The minimum is raised to the overlap where it is smaller, since such windows might not move on.
    """
    columns = []
    for size, overlap in product(sizes or C.CHUNK_SIZES, overlaps or C.CHUNK_OVERLAPS):
        floor = max(minimum, overlap)
        spans = sentence_windows(text_col, size, overlap, floor)
        lengths = F.transform(
            spans, lambda s: F.length(strip(F.substring(F.col(text_col), s["s"] + 1, s["e"] - s["s"])))
        )
        columns.append(
            F.struct(
                F.lit(size).cast("bigint").alias("chunk_size"),
                F.lit(overlap).cast("bigint").alias("overlap"),
                F.filter(lengths, lambda n, i: (n >= floor) | (i == 0)).alias("lengths"),
            )
        )
    settings = each_struct(texts, [], F.array(*columns), "chunk_size")
    kept = each(settings, ["chunk_size", "overlap"], "lengths", "n")
    return kept.groupBy("chunk_size", "overlap").agg(
        F.count("*").alias("total_chunks"),
        F.round(F.avg("n"), 6).alias("avg_chunk_length"),
        F.min("n").cast("bigint").alias("min_chunk_length"),
        F.max("n").cast("bigint").alias("max_chunk_length"),
    )


def summarise(grid: DataFrame, by: str) -> DataFrame:
    """Mean of the grid's columns per size or overlap, two digits."""
    names = [c for c in grid.columns if c not in ("chunk_size", "overlap")]
    return grid.groupBy(by).agg(*[F.round(F.avg(c), 2).alias(c) for c in names])


def compare_runs(runs: dict[str, DataFrame], judgements: DataFrame, queries: DataFrame) -> DataFrame:
    """Quality of several retrieval methods, one row each."""
    rows = [
        E.averages(E.per_query(run, judgements, queries)).withColumn("method", F.lit(name))
        for name, run in runs.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours an approximate run found."""
    total = exact.select(F.count("*")).scalar()
    found = exact.join(approximate.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return found.agg(
        F.count("*").alias("n_found"), F.round(F.try_divide(F.count("*"), total), 6).alias("recall")
    )
