"""Connected components of an edge table as alternating stars over DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import discard, write_through

EDGES = 200_000


def _star(edges: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour (or the node itself) of ``u``.

    The minimum is a partial aggregate and the join's other side has one row per node, so a hub
    is combined map-side and its rows can be split by the adaptive skew join.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    stars = _star(edges.where("u > v"))
    links = stars.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = stars.select("u", F.col("m").alias("v"))
    return links.unionAll(own)


def _forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task links the nodes of a bounded batch to their smallest."""

    def run(batches):
        for batch in batches:
            above: dict = {}

            def root(node):
                path = []
                while (up := above.get(node, node)) != node:
                    path.append(node)
                    node = up
                for p in path:
                    above[p] = node
                return node

            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    above[max(a, b)] = min(a, b)
            nodes = list(above)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field("u").type), pa.array([root(n) for n in nodes], batch.schema.field("v").type)], ["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def _few(edges: DataFrame, rows: int) -> DataFrame:
    """Files of some hundred thousand edges: a round over a small graph writes one, not one per partition."""
    return edges.coalesce(rows // EDGES + 1)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``node, component`` of every node that has an edge; a component is named by its smallest node.

    Each round is written to the shared folder, which cuts the lineage and survives lost executors.
    Rounds grow with the logarithm of the longest path. Self-loops and NULL ends are no links; an
    empty edge table gives an empty result.
    """
    own = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v")
    current = write_through(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(current)
    last, current = current, write_through(_few(_forest(current), mark[0]), "edges")
    discard(last)
    mark = _mark(current)
    while mark[0]:
        step = _small_star(_large_star(current).distinct())
        last, current = current, write_through(_few(step.where("u <> v").distinct(), mark[0]), "edges")
        discard(last)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
