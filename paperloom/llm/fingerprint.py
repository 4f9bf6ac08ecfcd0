"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, and never fewer than the
``least`` smallest. Both rules carry over to unions, so sketches merge without the texts. A
sketch is complete below its own bound: the fixed share, or its largest hash where it had to be
filled up, or everything where it holds all shingles. Two sketches are compared below the smaller
bound; likeness is the shared part of the smaller one, which estimates containment however unequal
the documents are.

Cases: a NULL text counts as empty; an empty sketch is like an empty one (1) and unlike others (0). A
text with fewer words than a shingle is one shingle. Equal doc_ids are ordered by a hash of the
text; NULL ids come last in the descending order. A single row's next document is itself. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, register, table
from paperloom.llm.simhash import shingle_hashes

WIDTH, SHARE, LEAST = 5, 8, 16
TOP = (1 << 64) - 1


def sketch(text: str | None, width: int = WIDTH, share: int = SHARE, least: int = LEAST) -> np.ndarray:
    """Kept hashes in ascending order."""
    hashes = np.unique(shingle_hashes(text, width))
    return hashes[: max(least, int(np.searchsorted(hashes, np.uint64(TOP // share), "right")))]


def bound(hashes: np.ndarray, share: int = SHARE, least: int = LEAST) -> int:
    """The hash up to which a sketch is complete."""
    limit = TOP // share
    if len(hashes) < least:
        return TOP
    return max(limit, int(hashes[-1]))


def merged(a: np.ndarray, b: np.ndarray, share: int = SHARE, least: int = LEAST) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    return both[: max(least, int(np.searchsorted(both, np.uint64(TOP // share), "right")))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the smaller sketch below the smaller bound, 0 to 1."""
    limit = np.uint64(min(bound(a), bound(b)))
    a, b = a[a <= limit], b[b <= limit]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def _compared(texts: pa.Array, edited: pa.Array, following: pa.Array) -> pa.Array:
    rows, known, held = [], None, None
    for text, edit, after in zip(texts, edited, following):
        text = text.as_py()
        own = held if known is not None and text == known else sketch(text)
        other = sketch(edit.as_py())
        known = after.as_py()  # mostly the text of the row to come
        held = sketch(known)
        rows.append({"fingerprint": _hex(own), "edited_fingerprint": _hex(other), "near_edited": likeness(own, other), "near_next": likeness(own, held)})
    kind = pa.struct([("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return pa.array(rows, kind)


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text, following``: every row with the text that follows in descending key order, cyclically.

    Keys are cut into ranges at approximate quantiles (a column-pruned scan), so each text moves
    once. The first row of each range joins the range before it as a guest at the end; there is
    one guest per range, and only their ids reach the driver.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.select("id").where("id IS NOT NULL").approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))

    def place(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = len(bounds) - np.searchsorted(bounds, values, "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, found).astype(np.int32))

    range_of = arrow(place, "int")
    tie = F.xxhash64("text")
    placed = rows.select("id", "text", range_of("id").alias("part"))
    first = rows.select("id", range_of("id").alias("part")).groupBy("part").agg(F.max("id").alias("id"))
    heads = [(r["part"], r["id"]) for r in first.orderBy("part").collect()]
    ends = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    wanted = F.broadcast(spark.createDataFrame(ends, "part int, head bigint"))
    guests = rows.join(wanted, F.col("id").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min_by("text", F.struct(tie, "text")).alias("text"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests.select(F.lit(None).cast("bigint").alias("id"), "text", "part", F.lit(True).alias("guest")))
    order = Window.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), tie, "text")
    return both.withColumn("following", F.lead("text").over(order)).where(~F.col("guest")).select("id", "text", "following")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its second half taken from the next document."""
    rows = with_next(documents, key, text)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("following"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    compared = arrow(_compared, "struct<fingerprint string, edited_fingerprint string, near_edited double, near_next double>")
    rows = rows.select(F.col("id").alias(key), size.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), compared("text", "edited", "following").alias("c"))
    return rows.select(key, "n_chars", "edited_sha256", "c.*")


@register("op7_fingerprint")
def op7_fingerprint(spark, folder):
    """Sketches of all documents, of their edited texts, and how near they are."""
    return fingerprints(table(spark, folder, "documents"))
