"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Every document has a fixed hash. A source takes its documents as often as its target allows as a whole, and
once more those whose hash lies below a threshold. The threshold comes from histograms: sizes are
summed by source and the first 12 bits of the hash, the bucket in which the budget ends is the boundary, and
only its documents are summed again by their next 12 bits, until the boundary is one hash. It is taken or
left, whichever is nearer to the target. Nothing is sorted but the at most 4,096 buckets of a source; for a
larger budget a threshold only rises, so a larger mix contains a smaller one.

Targets: sources weigh in turn, in order of their names, and share ``share`` of all sizes; what is above ``most``
times a source's size goes to the others by weight until none is above.

Cases: a NULL text has size 0, a NULL source is the last one. Hashes are of doc_id and text, so reruns agree and
documents that are equal in both are taken or left together. Sources without words have target 0. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.base import register, table
from paperloom.operators.numbering import group_key, numbered
from paperloom.session import fits_broadcast, write_through

DIGITS, STEP = 15, 3  # a hash of 60 bits, 12 at a time
WEIGHTS = (5, 2, 1)
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(key: Column, text: Column) -> Column:
    """The hash of a document as hexadecimal digits, which order like it."""
    return F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")), 1, DIGITS)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``grp, size, target`` of sources (``grp``, ``ord``, ``size``).

    Capped sources leave their excess to the others. In each round the level (words for a weight of one)
    follows from two sums; sources above their cap at that level are capped from then on, as the level
    only rises. Only the sums reach the driver.
    """
    ranked = numbered(sizes.withColumn("one", F.lit("")), "one", ["ord"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = write_through(ranked.select("grp", "size", weight.alias("weight")), "weights")
    cap = F.col("size") * F.lit(most)
    total = (ranked.agg(F.sum("size")).first()[0] or 0) * share
    level, free = 0.0, None
    while True:
        capped = cap < F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(capped, cap)).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(~capped).alias("free")).first()
        if not row["free"]:
            level = math.inf
        if not row["free"] or row["free"] == free:
            break
        free, level = row["free"], (total - (row["held"] or 0.0)) / row["weight"]
    return ranked.select("grp", "size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``grp, edge``: the documents of ``rows`` (grp, hash, size) with a hash below ``edge`` come nearest to the budget.

    ``goals`` has a row (grp, budget) per source; sources that need no document are left out.
    """
    found, width = None, 0
    state = goals.where("budget > 0").select("grp", "budget", F.lit("").alias("prefix"))
    state, inside = write_through(state, "state"), rows
    while width < DIGITS:
        width += STEP
        sums = inside.groupBy("grp", F.substring("hash", 1, width).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        order = Window.partitionBy("grp").orderBy("bucket")
        after = F.sum("size").over(order)
        near = sums.join(state, "grp").withColumn("after", after).withColumn("before", F.col("after") - F.col("size"))
        edge = near.where("before < budget AND after >= budget").select("grp", "bucket", "size", "low", "high", "before", "budget")
        edge = write_through(edge, "boundary")
        # A bucket of one hash is taken if that is nearer than leaving it.
        more = F.col("budget") - F.col("before")
        last = edge.where("low = high").select("grp", F.when(more * 2 > F.col("size"), F.concat("high", F.lit("~"))).otherwise(F.col("low")).alias("edge"))
        found = last if found is None else found.unionAll(last)
        state = edge.where("low < high").select("grp", more.alias("budget"), F.col("bucket").alias("prefix"))
        if not state.head(1):
            break
        open_ = state.select("grp", F.col("prefix").alias("bucket"))
        inside = rows.withColumn("bucket", F.substring("hash", 1, width)).join(F.broadcast(open_) if fits_broadcast(open_) else open_, ["grp", "bucket"], "left_semi").drop("bucket")
    return found


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``key, size, source_size, target, taken`` of every document.

    ``taken`` is the size times the number of times that the mix takes the document.
    """
    names = group_key(F.col(source))
    rows = documents.select(F.col(key).alias("id"), names.alias("grp"), words(F.col(text)).alias("size"), place(F.col(key), F.col(text)).alias("hash"))
    rows = write_through(rows, "sized")
    sizes = rows.groupBy("grp").agg(F.sum("size").alias("size")).withColumn("ord", F.when(F.col("grp") == "", F.lit("~")).otherwise(F.col("grp")))
    goals = write_through(targets(sizes, share, most), "targets")
    times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    goals = goals.withColumn("times", times.cast("bigint"))
    edges = thresholds(rows, goals.select("grp", (F.col("target") - F.col("times") * F.col("size")).alias("budget")))
    plan = write_through(goals.join(edges, "grp", "left").select("grp", F.col("size").alias("source_size"), "target", "times", "edge"), "plan")
    if fits_broadcast(plan):
        chosen = rows.join(F.broadcast(plan), "grp")
    else:  # the rows of a large source meet its one row in shares
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chosen = rows.withColumn("salt", F.pmod(F.hash("hash"), F.lit(SALTS))).join(salted, ["grp", "salt"])
    taken = F.col("size") * (F.col("times") + F.when(F.col("hash") < F.col("edge"), 1).otherwise(0))
    return chosen.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 15) AS hash
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM docs GROUP BY source
), levels AS (  -- sources in the order in which a rising level reaches their caps
    SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM sources) - coalesce(sum(size * 2) OVER before, 0)) / sum(weight) OVER here AS level, row_number() OVER here AS turn
    FROM sources
    WINDOW before AS (ORDER BY size * 2.0::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        here AS (ORDER BY size * 2.0::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT arg_min(level, turn) AS level FROM levels WHERE level <= size * 2.0::DOUBLE / weight
), goals AS (
    SELECT source, size, least(size * 2.0::DOUBLE, weight * coalesce((SELECT level FROM level), 'inf'::DOUBLE)) AS target FROM sources
), plan AS (
    SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END::BIGINT AS times FROM goals
), hashes AS (
    SELECT source, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS after FROM docs GROUP BY source, hash
), chosen AS (
    SELECT h.source, h.hash, p.size AS source_size, p.target, times,
        CASE WHEN after - h.size < budget AND (after < budget OR 2 * (budget - (after - h.size)) > h.size) THEN 1 ELSE 0 END AS more
    FROM hashes h JOIN (SELECT *, target - times * size AS budget FROM plan) p ON h.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (times + more))::BIGINT AS taken
FROM docs d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.hash = c.hash
"""


@register("op13_mixture", SQL)
def op13_mixture(spark, folder):
    """How many words of each document go into the mix of all sources."""
    return mix(table(spark, folder, "documents"))
