"""Exact and probed inner-product search over normalised vectors.

Vectors never move for a bounded query set: the normalised query matrix goes to every task,
each task multiplies its Arrow batches with it and keeps the best ``k`` per query, and only
those meet in the final ranking. Larger query sets are laid out as a grid of bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.ranking import ranked
from paperloom.session import discard, write_through

SCORE_DIGITS = 6
QUERY_BLOCK = 256


@dataclass(frozen=True)
class _Best:
    """Best rows of one query so far."""

    scores: np.ndarray
    ids: np.ndarray


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(rows, vector: str, dim: int):
    """The rows of a batch or table whose vector has ``dim`` components, none of them missing."""
    column = rows.column(vector)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False)
    if column.flatten().null_count:
        owner = pc.list_parent_indices(column).to_numpy()
        fits[owner[column.flatten().is_null().to_numpy(zero_copy_only=False)]] = False
    return rows if fits.all() else rows.filter(pa.array(fits))


def _common_size(sizes: dict[int, int]) -> int:
    """The most frequent size, of equally frequent ones the smallest."""
    return min(sizes, key=lambda n: (-sizes[n], n), default=0)


def _normalised(matrix: np.ndarray, eps: float) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True) + eps
    return matrix / np.where(norms == 0, 1.0, norms)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_pylist())


def _pick(scores: np.ndarray, ids: np.ndarray, k: int, high_id_first: bool) -> np.ndarray:
    """Positions of the best ``k`` by score, ties by id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= limit)
    else:
        kept = np.arange(len(scores))
    _, place = np.unique(ids[kept], return_inverse=True)
    order = np.lexsort((-place if high_id_first else place, -scores[kept]))
    return kept[order[:k]]


def _merge(best: _Best | None, scores: np.ndarray, ids: np.ndarray, k: int, high: bool) -> _Best:
    if best is not None:
        scores = np.concatenate([best.scores, scores])
        ids = np.concatenate([best.ids, ids])
    picked = _pick(scores, ids, k, high)
    return _Best(scores[picked], ids[picked])


def _scan(
    best: dict[int, _Best],
    asked: np.ndarray,
    stored: np.ndarray,
    ids: np.ndarray,
    k: int,
    high: bool,
    lists: np.ndarray | None = None,
    probes: list | None = None,
) -> None:
    """Score stored vectors against all questions, a bounded block of questions at a time."""
    for start in range(0, len(asked), QUERY_BLOCK):
        scores = np.round(asked[start : start + QUERY_BLOCK] @ stored.T, SCORE_DIGITS)
        for offset, row in enumerate(scores):
            number, row_ids = start + offset, ids
            if lists is not None:
                mask = np.isin(lists, list(probes[number]))
                row, row_ids = row[mask], ids[mask]
            if len(row):
                best[number] = _merge(best.get(number), row, row_ids, k, high)


def _rows(query_ids: list, best: dict[int, _Best], types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    q, i, s = [], [], []
    for number, rows in best.items():
        q.extend([query_ids[number]] * len(rows.scores))
        i.extend(rows.ids.tolist())
        s.extend(rows.scores.tolist())
    return pa.RecordBatch.from_arrays(
        [pa.array(q, types[0]), pa.array(i, types[1]), pa.array(s, pa.float64())],
        names=["query_id", "id", "score"],
    )


def _schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(kind, T.StringType) else pa.from_numpy_dtype(
        {"bigint": np.int64, "int": np.int32}[kind.simpleString()]
    )


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    eps: float = 0.0,
    high_id_first: bool = False,
    probes_col: str | None = None,
    list_col: str | None = None,
    max_queries: int = 4096,
    block_rows: int = 200_000,
    dim: int | None = None,
) -> DataFrame:
    """Top ``k`` vectors per query by cosine: ``query_id, id, score, rank``.

    Only vectors of ``dim`` components can be compared, by default the most frequent size of the questions; others,
    on either side, are left out, see :func:`unusable_vectors`. They are dropped inside the scan, so an
    encoder above the stored side runs once. With ``probes_col`` (an array of list numbers on the query side) and ``list_col`` (the list
    number of a vector) each query sees only the lists it probes.
    """
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")]
    asked_cols = [F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")]
    if list_col:
        columns.append(F.col(list_col).cast("int").alias("list_no"))
        asked_cols.append(F.col(probes_col).cast("array<int>").alias("probes"))
    stored, asked = vectors.select(*columns), queries.select(*asked_cols)
    rows = asked.limit(max_queries + 1).collect()
    few = len(rows) <= max_queries
    if dim is None and few:
        sizes = [len(r["vector"]) for r in rows if r["vector"]]
        dim = _common_size({n: sizes.count(n) for n in set(sizes)})
    elif dim is None:  # kinds of sizes, not questions
        size = F.size("vector").alias("n")
        dim = _common_size({r["n"]: r["count"] for r in asked.select(size).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()})
    if few:
        rows = [r for r in rows if r["vector"] is not None and len(r["vector"]) == dim and None not in r["vector"]]
        best = _by_broadcast(stored, asked, rows, k, eps, high_id_first, dim)
    else:
        best = _by_grid(stored, asked, k, eps, high_id_first, max_queries, block_rows, dim)
    order = [F.desc("score"), F.desc("id") if high_id_first else F.asc("id")]
    return ranked(best, ["query_id"], order).where(F.col("rank") <= k)


def unusable_vectors(vectors: DataFrame, dim: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Ids and sizes of vectors that a search over ``dim`` components leaves out (size NULL: none stored)."""
    size = F.size(vector_col)
    return vectors.where(F.coalesce(size != dim, F.lit(True))).select(F.col(id_col).alias("id"), F.when(F.col(vector_col).isNotNull(), size).alias("size"))


def _by_broadcast(
    stored: DataFrame, asked: DataFrame, rows: list, k: int, eps: float, high: bool, dim: int
) -> DataFrame:
    schema = _schema(asked, stored)
    types = (_arrow(schema["query_id"].dataType), _arrow(schema["id"].dataType))
    probing = "probes" in asked.columns
    payload = stored.sparkSession.sparkContext.broadcast(
        (
            [r["query_id"] for r in rows],
            _normalised(np.array([r["vector"] for r in rows], dtype=np.float64), eps) if rows else None,
            [set(r["probes"]) for r in rows] if probing else None,
        )
    )
    if probing:
        # only probed lists are read at all
        probed = sorted({n for r in rows for n in r["probes"]})
        stored = stored.where(F.col("list_no").isin(probed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, probes = payload.value
        best: dict[int, _Best] = {}
        for batch in batches:
            batch = _usable(batch, "vector", dim)
            if batch.num_rows and matrix is not None:
                vectors = _normalised(_matrix(batch.column("vector")), eps)
                lists = batch.column("list_no").to_numpy() if probes else None
                _scan(best, matrix, vectors, _ids(batch.column("id")), k, high, lists, probes)
        if best:
            yield _rows(query_ids, best, types)

    return stored.mapInArrow(scan, schema)


def _by_grid(
    stored: DataFrame, asked: DataFrame, k: int, eps: float, high: bool, max_queries: int, block_rows: int, dim: int
) -> DataFrame:
    """Blocks of queries against blocks of vectors, both of bounded size.

    Ids are spread by hash, so blocks stay even whatever the data looks like.
    """
    schema = _schema(asked, stored)
    types = (_arrow(schema["query_id"].dataType), _arrow(schema["id"].dataType))
    query_blocks = math.ceil(asked.count() / max_queries)
    vector_blocks = max(1, math.ceil(stored.count() / block_rows))
    probing = "probes" in asked.columns

    def block(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = asked.withColumn("qb", block("query_id", query_blocks)).withColumn("vb", every(vector_blocks))
    right = stored.withColumn("vb", block("id", vector_blocks)).withColumn("qb", every(query_blocks))

    def cell(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        best: dict[int, _Best] = {}
        queries, vectors = _usable(queries, "vector", dim), _usable(vectors, "vector", dim)
        query_ids = queries.column("query_id").to_pylist()
        if queries.num_rows and vectors.num_rows:
            _scan(
                best,
                _normalised(_matrix(queries.column("vector")), eps),
                _normalised(_matrix(vectors.column("vector")), eps),
                _ids(vectors.column("id")),
                k,
                high,
                vectors.column("list_no").to_numpy() if probing else None,
                queries.column("probes").to_pylist() if probing else None,
            )
        return pa.Table.from_batches([_rows(query_ids, best, types)])

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(cell, schema)


def assign_lists(
    vectors: DataFrame, centroids: DataFrame, vector_col: str = "embedding", block: int = 65_536
) -> DataFrame:
    """Add ``list_no``, the number of the closest centroid by inner product, of equally close ones the smallest.

    ``centroids`` holds ``list_no, embedding``. They are scored in blocks of at most about ``block``, one after the
    other, so their number has no limit; between blocks the best so far is written. Vectors of another size
    than the centroids' have no list (NULL).
    """
    own, closest = vectors.columns, "list_no"
    rows = centroids.select("list_no", "embedding")
    parts = max(1, math.ceil(rows.count() / block))
    sizes = {r["n"]: r["count"] for r in rows.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()}
    dim, last = _common_size(sizes), None
    found = vectors.withColumns({closest: F.lit(None).cast("int"), "_score": F.lit(None).cast("double")})
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("list_no"), F.lit(parts)) == part).collect()
        some = sorted((r for r in some if r["embedding"] is not None and len(r["embedding"]) == dim), key=lambda r: r["list_no"])
        if not some:
            continue
        numbers = np.array([r["list_no"] for r in some], dtype=np.int32)
        matrix = _normalised(np.array([r["embedding"] for r in some], dtype=np.float64), 0.0)
        payload = vectors.sparkSession.sparkContext.broadcast((numbers, matrix))
        found = found.mapInArrow(_closer(payload, vector_col, dim), found.schema)
        if parts > 1:
            found = write_through(found, "assigned")
            payload.destroy()
            if last is not None:
                discard(last)
            last = found
    return found.select(*own, closest)


def _closer(payload, vector_col: str, dim: int):
    """Batches with ``list_no`` and ``_score`` of the best centroid so far."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, matrix = payload.value
        for batch in batches:
            place = np.arange(batch.num_rows)
            rows = _usable(batch.append_column("_at", pa.array(place)), vector_col, dim)
            score, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_score", "list_no"))
            if rows.num_rows:
                at = rows.column("_at").to_numpy()
                scores = np.round(_normalised(_matrix(rows.column(vector_col)), 0.0) @ matrix.T, SCORE_DIGITS)
                best = scores.argmax(axis=1)
                new, own = scores[np.arange(len(at)), best], numbers[best].astype(np.float64)
                better = np.isnan(score[at]) | (new > score[at]) | ((new == score[at]) & (own < number[at]))
                score[at[better]], number[at[better]] = new[better], own[better]
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns["_score"] = pa.array(score, pa.float64(), from_pandas=True)
            columns["list_no"] = pa.array(number, from_pandas=True).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return assign


def search_by_kind(kind: str, vectors: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """``flat`` is exact; ``ivf`` needs ``centroids`` and assigned vectors. No other kind exists."""
    if kind == "flat":
        return dense_topk(vectors, queries, k, **options)
    if kind == "ivf":
        return probed_topk(vectors, queries, options.pop("centroids"), k, **options)
    raise ValueError(f"unsupported index kind {kind!r}: use flat or ivf")


def train_lists(vectors: DataFrame, n_lists: int, vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Centroids of a distributed k-means: ``list_no, embedding``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=20).fit(data)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centers, "list_no int, embedding array<double>")


def probed_topk(
    vectors: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    k: int = 10,
    n_probe: int = 10,
    id_col: str = "chunk_id",
    list_col: str = "list_no",
    **options,
) -> DataFrame:
    """Top ``k`` inside the ``n_probe`` closest lists of each query.

    ``vectors`` already carry their list number; stored partitioned by it, unprobed lists are
    not read.
    """
    probes = (
        dense_topk(centroids, queries, n_probe, id_col="list_no")
        .groupBy("query_id")
        .agg(F.collect_list("id").alias("probes"))
    )
    asked = queries.join(probes, "query_id")
    return dense_topk(
        vectors, asked, k, id_col=id_col, probes_col="probes", list_col=list_col, **options
    )


def mean_vectors(vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per key, summed inside the tasks before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    return (
        vectors.select(key, as_vector.alias("v"))
        .groupBy(key)
        .agg(Summarizer.mean(F.col("v")).alias("m"))
        .select(key, vector_to_array("m").alias(vector_col))
    )
