"""Retrieval quality. Runs: ``query_id, id, rank``; judgements: ``query_id, id``.

Metrics join on (query, document), so neither a popular document nor a query with very many
relevant ones gathers in one task; everything else is counted before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import let
from paperloom.session import write_through


_SCORES = ("precision", "recall", "f1", "table_recall")


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(n: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    return F.when(
        n > 0, F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    ).otherwise(F.lit(0.0))


def per_query(
    run: DataFrame, judgements: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = (3, 5, 10)
) -> DataFrame:
    """``query_id, n_relevant, n_retrieved, n_hits, recall_<k>…, mrr, ndcg``.

    ``queries`` lists every query asked, so those without hits count as zero. Recall looks at
    the first ``k`` places, reciprocal rank and gain at the whole run; the ideal gain has as
    many places as the shorter of run and relevant set.
    """
    judged = judgements.select("query_id", "id").distinct()
    relevant = judged.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    found = run.join(judged.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    rank = F.when(F.col("hit"), F.col("rank"))
    hits = found.groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count(rank).alias("n_hits"),
        F.min(rank).alias("first_rank"),
        F.sum(_gain(rank)).alias("gain"),
        *[F.count_if(rank <= k).alias(f"hits_{k}") for k in cutoffs],
    )
    table = queries.select("query_id").join(relevant, "query_id", "left").join(hits, "query_id", "left")
    table = table.fillna(0)
    ideal = _ideal(F.least("n_relevant", "n_retrieved"))
    return table.select(
        "query_id",
        "n_relevant",
        "n_retrieved",
        "n_hits",
        *[
            F.coalesce(F.try_divide(f"hits_{k}", "n_relevant"), F.lit(0.0)).alias(f"recall_{k}")
            for k in cutoffs
        ],
        F.when(F.col("n_hits") > 0, F.lit(1.0) / F.col("first_rank")).otherwise(F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(F.col("gain"), ideal), F.lit(0.0)).alias("ndcg"),
    )


def averages(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every recall, reciprocal rank and gain; NULL, not an error, without queries."""
    names = [c for c in scores.columns if c.startswith("recall_") or c in ("mrr", "ndcg")]
    return scores.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names]
    )


def hit_ranks(run: DataFrame, judgements: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query with the rank of its first target, NULL if none was retrieved."""
    judged = judgements.select("query_id", "id").distinct()
    first = run.join(judged, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.join(first, "query_id", "left")


def hits_by_type(ranks: DataFrame, type_col: str, cutoffs: list[int]) -> DataFrame:
    """Hits at every cutoff per query type and overall (type NULL)."""
    counts = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in cutoffs]
    return ranks.groupingSets([[type_col], []], type_col).agg(F.count("*").alias("total"), *counts)


def hit_classes(classes: DataFrame) -> DataFrame:
    """Counts and shares of chunk, page and missed queries from ``chunk_hit, page_hit``."""
    name = F.when(F.col("chunk_hit"), "chunk").when(F.col("page_hit"), "page").otherwise("missed")
    counted = classes.groupBy(name.alias("hit_class")).agg(F.count("*").alias("n_queries"))
    total = counted.select(F.sum("n_queries")).scalar()
    return counted.withColumn("share", F.round(F.col("n_queries") / total, 6))


def rank_statistics(ranks: DataFrame, by: str) -> DataFrame:
    """Spread of the hit ranks per group: counts, upper median, mean, extremes.

    The median is read off the histogram of ranks, which is as long as the deepest rank and
    not as the number of queries.
    """
    histogram = ranks.groupBy(by, "rank").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = histogram.where("rank IS NOT NULL").withColumn("cum", F.sum("n").over(up_to))
    total = F.sum("n").over(Window.partitionBy(by))
    found = found.withColumn("n_found", total).withColumn(
        "above_half", F.col("cum") > F.floor(F.col("n_found") / 2)
    )
    return found.groupBy(by).agg(
        F.max("n_found").alias("n_found"),
        F.min(F.when(F.col("above_half"), F.col("rank"))).alias("median_rank"),
        F.round(F.sum(F.col("rank") * F.col("n")) / F.sum("n"), 6).alias("mean_rank"),
        F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"),
    )


def rank_buckets(ranks: DataFrame) -> DataFrame:
    """Number of queries per bucket of first hit ranks."""
    name = F.lit(None).cast("string")
    for low, high in C.RANK_BUCKETS:
        name = F.when(F.col("rank").between(low, high), f"{low}-{high}").otherwise(name)
    return (
        ranks.where("rank IS NOT NULL").groupBy(name.alias("bucket")).agg(F.count("*").alias("n_queries"))
    )


def best_by(df: DataFrame, metric: str, order: list[Column]) -> DataFrame:
    """Row with the highest metric, first in the given order among equals."""
    return df.orderBy(F.desc(metric), *order).limit(1)


def text_overlap(extracted: Column, truth: Column) -> Column:
    """Precision, recall and F1 of two word sets."""

    def scores(sizes: Column) -> Column:
        shared, usable = sizes["shared"], sizes["truth"] > 0
        precision = F.when(usable & (sizes["extracted"] > 0), shared / sizes["extracted"]).otherwise(F.lit(0.0))
        recall = F.when(usable, shared / sizes["truth"]).otherwise(F.lit(0.0))
        return let(F.struct(precision.alias("precision"), recall.alias("recall")), with_f1)

    def with_f1(s: Column) -> Column:
        p, r = s["precision"], s["recall"]
        return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))

    return let(F.struct(F.size(F.array_intersect(extracted, truth)).alias("shared"), F.size(extracted).alias("extracted"), F.size(truth).alias("truth")), scores)


def _rows_of_tables(*columns: pa.Array) -> Iterator[tuple]:
    """Row by row the tables of all columns, a table as its cells by number; equal cells have equal numbers, NULL stays None."""
    tables = [column.flatten() for column in columns]  # without what lies under NULL
    cells = pa.chunked_array([t.flatten().cast(pa.large_string()) for t in tables]).combine_chunks()
    numbers = pc.dictionary_encode(cells, null_encoding="encode").indices.to_numpy()
    begins = np.cumsum([0, *(pc.sum(pc.list_value_length(t)).as_py() or 0 for t in tables)])

    def rows(column: pa.Array, inner: pa.Array, at: int):
        widths = iter(pc.list_value_length(inner).to_pylist())
        for size in pc.list_value_length(column).to_pylist():
            if size is None:
                yield None
                continue
            row = []
            for width in islice(widths, size):
                row.append(None if width is None else numbers[at : at + width])
                at += width or 0
            yield row

    return zip(*map(rows, columns, tables, begins.tolist()))


def _matched(seen: list, wanted: list, limit: float) -> int:
    """How many wanted tables have a seen one whose cells are alike by more than the limit.

    A table without an equal lacks a few cells in any table like it. Among its rarest cells, one more than it can
    lack, every such table has one, so that only tables with one of these cells and of a fitting size are compared.
    """
    same = {t.tobytes(): t for t in seen if t is not None and len(t)}
    asked = [t for t in wanted if t is not None and len(t)]
    rest = [t for t in asked if t.tobytes() not in same]  # the others have an equal, cell by cell
    found = len(asked) - len(rest)
    known = {frozenset(t.tolist()) for t in same.values()} if rest else set()
    holders = None
    for own in (frozenset(t.tolist()) for t in rest):
        if own in known:
            found += 1
            continue
        n = len(own)
        if holders is None:
            holders = {}
            for other in known:
                for cell in other:
                    holders.setdefault(cell, []).append(other)
        lacked = n - math.ceil(limit * n - 1e-9)  # at most so many
        rare = sorted(own, key=lambda c: len(holders.get(c, ())))[: lacked + 1]
        least, most = limit * n - 1e-9, n / limit + 1e-9
        tried = {other for c in rare for other in holders.get(c, ()) if least <= len(other) <= most}
        for other in tried:
            shared = len(own & other)
            if shared / (n + len(other) - shared) > limit:
                found += 1
                break
    return found


def table_recall(extracted: Column, truth: Column) -> Column:
    """Share of truth tables matched by an extracted one; both are arrays of cell sets."""
    limit = C.TABLE_MATCH_LIMIT

    @F.arrow_udf("double")
    def recall(seen: pa.Array, wanted: pa.Array) -> pa.Array:
        shares = []
        for have, asked in _rows_of_tables(seen, wanted):
            if asked:
                shares.append(_matched(have or [], asked, limit) / len(asked))
            else:
                shares.append(0.0 if have else 1.0)
        return pa.array(shares, pa.float64())

    return recall(extracted, truth)


def _width(tables: Column) -> Column:
    """About the bytes that a table list takes in a row."""
    return F.aggregate(tables, F.lit(0).cast("bigint"), lambda n, t: n + F.lit(16) * F.coalesce(F.size(t), F.lit(0)))


def compare_extractions(methods: dict[str, DataFrame], truth: DataFrame, key: str = "doc_id", pass_bytes: int = 512 << 20, most: int = 6) -> DataFrame:
    """Mean text precision, recall, F1 and table recall of several extractions of the same documents.

    All tables have ``key, words, tables`` (a set of words, an array of cell sets). A document that an
    extraction lacks counts with empty sets. Every extraction meets the truth in one join; of a key that comes several times
    all pairs of rows count, once for each row of the truth. Arrays are many times as large as the texts they come from, so
    large tables meet in up to ``most`` passes, each over the documents of its own hash of the key, of about ``pass_bytes`` of the truth.
    """
    none = F.array().cast("array<string>")
    truth = truth.where(F.col(key).isNotNull())

    def own(df: DataFrame, part: int, parts: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)) == part) if parts > 1 else df

    def sums(part: int, parts: int) -> DataFrame:
        known = own(truth, part, parts).select(key, F.col("words").alias("_words"), F.col("tables").alias("_tables"))
        known = known.withColumn("_times", F.count("*").over(Window.partitionBy(key)))
        found = []
        for name, df in methods.items():
            met = known.join(own(df, part, parts).select(key, "words", "tables"), key, "left")
            seen, tables = F.coalesce("words", none), F.coalesce("tables", F.array().cast("array<array<string>>"))
            found.append(met.select(F.lit(name).alias("method"), "_times", text_overlap(seen, F.col("_words")).alias("s"), table_recall(tables, F.col("_tables")).alias("table_recall")))
        scores = reduce(DataFrame.unionByName, found).select("method", "_times", "s.*", "table_recall")
        return scores.groupBy("method").agg(F.sum("_times").alias("n"), *[F.sum(F.col(c) * F.col("_times")).alias(c) for c in _SCORES])

    width = F.lit(16) * F.coalesce(F.size("words"), F.lit(0)) + F.coalesce(_width(F.col("tables")), F.lit(0))
    slices = 64  # one of them tells the size of all
    parts = min(most, math.ceil(slices * (own(truth, 0, slices).agg(F.sum(width)).first()[0] or 0) / pass_bytes))
    total = sums(0, 1) if parts <= 1 else reduce(DataFrame.unionByName, [write_through(sums(part, parts), "compared") for part in range(parts)])
    return total.groupBy("method").agg(F.sum("n").alias("n_documents"), *[F.round(F.sum(c) / F.sum("n"), 6).alias(c) for c in _SCORES])
