"""Lexical index and ranked term search.

Postings carry the document length, so scoring joins nothing but the query terms. Every
shuffle is keyed by document, (document, term) or, after map-side counting, by term:
a term held by a third of all documents never ends up in one task. Tables of (document, term) and of
(query, document) are built in partitions whose number grows with their rows, so no task holds more as collections grow.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import constants as C
from paperloom.functions.tokens import tokenize
from paperloom.operators.ranking import top_k
from paperloom.operators.rows import each, parts_for
from paperloom.session import discard, fits_broadcast, shuffles_freed, write_through

SCORE_DIGITS = 6
TERM_BUCKETS = 256
TASK_TOKENS = 1 << 20  # tokens counted by one task
TASK_PAIRS = 1 << 20  # (query, document) pairs scored by one task
TASK_BYTES = 16 << 20  # text tokenised and counted by one task
SLICE_TOKENS, SLICES = 1 << 22, 8  # tokens whose postings are stored at a time, and how many times at most


@dataclass(frozen=True)
class LexicalIndex:
    """``lengths(id, dl)``, ``postings(bucket, term, id, tf, dl)`` and ``terms(term, df)``.

    A built index also has its written ``docs(id, tokens, dl)``, and all the tables written for it.
    """

    lengths: DataFrame
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame | None = None
    written: tuple[DataFrame, ...] = ()

    def discard(self) -> None:
        """Delete what was written to build the index, once it is saved and nothing else will read it."""
        for df in self.written:
            discard(df)

    def corpus(self) -> DataFrame:
        """One row: document count and mean document length."""
        return self.lengths.agg(
            F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
        )

    def idf(self) -> DataFrame:
        n_docs = self.lengths.select(F.count("*")).scalar()
        return self.terms.select("term", "df", idf(n_docs, F.col("df")).alias("idf"))

    def save(self, path: str, batch: str | None = None) -> None:
        """Write the three tables, or those of a further ``batch`` of documents next to the others.

        Postings lie in one folder per term bucket, so that a search reads only the buckets of
        its terms. They are ranged by bucket, term and id: a frequent term spreads over files. A
        batch that is written again replaces itself. Postings of many tokens are counted, ranged and written for some of the
        buckets at a time, so that little is shuffled at once.
        """

        def place(name: str) -> str:
            return os.path.join(path, name, *([f"batch={batch}"] if batch else []))

        slices = [self.postings]
        if self.docs is not None:
            n_tokens = self.docs.agg(F.sum("dl").alias("n")).first()["n"] or 0
            n = min(SLICES, math.ceil(n_tokens / SLICE_TOKENS))
            slices = [_postings(self.docs, part, n) for part in range(n)] if n > 1 else slices
        with shuffles_freed(self.lengths.sparkSession):
            self.terms.write.mode("overwrite").parquet(place("terms"))
            for part, postings in enumerate(slices):
                (
                    postings.repartitionByRange("bucket", "term", "id")
                    .sortWithinPartitions("bucket", "term", "id")
                    .write.mode("append" if part else "overwrite")
                    .partitionBy("bucket")
                    .parquet(place("postings"), compression="zstd")
                )
            self.lengths.write.mode("overwrite").parquet(place("lengths"))

    def without(self, other: LexicalIndex) -> LexicalIndex:
        """This index with the document frequencies of another one taken off; they may become negative."""
        less = other.terms.select("term", (-F.col("df")).alias("df"))
        return LexicalIndex(self.lengths, self.postings, self.terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")), self.docs, self.written + other.written)

    @classmethod
    def of(cls, lengths: DataFrame, postings: DataFrame, terms: DataFrame) -> LexicalIndex:
        """An index from the tables of several batches."""
        return cls(lengths.drop("batch"), postings.drop("batch"), terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """Stored tables; document frequencies add up over batches, whose documents differ."""
        lengths, postings, terms = [spark.read.parquet(os.path.join(path, n)) for n in ("lengths", "postings", "terms")]
        return cls.of(lengths, postings, terms)


def postings_schema(id_type: T.DataType) -> T.StructType:
    """Columns of stored postings, which may have no file to tell them."""
    kinds = {"term": T.StringType(), "id": id_type, "tf": T.LongType(), "dl": T.LongType(), "bucket": T.IntegerType()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def term_bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + b * dl / avgdl))


def _documents(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tokens = tokenize(text_col)
    return chunks.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn(
        "dl", F.size("tokens").cast("bigint")
    )


def _postings(docs: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """Term counts per document, of one of ``parts`` shares of the buckets; documents are dealt out whole, so the
    counting needs no other shuffle."""
    n_tokens = math.ceil((docs.agg(F.sum("dl").alias("n")).first()["n"] or 0) / parts)
    if parts > 1:
        docs = docs.withColumn("tokens", F.filter("tokens", lambda t: F.pmod(term_bucket(t), F.lit(parts)) == part))
    words = each(docs.repartition(parts_for(docs, n_tokens, TASK_TOKENS), "id"), ["id", "dl"], "tokens", "term")
    counted = words.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    return counted.select(term_bucket("term").alias("bucket"), "term", "id", "tf", "dl")


def _asked_postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of the asked terms; all other tokens of a document count under the empty term.

    The token counts therefore still add up to the size of the collection. The empty term is
    no token and, unlike NULL, invites no filter that would set apart the plans sharing this.
    """
    known = F.broadcast(vocabulary.withColumn("known", F.lit(True)))
    words = docs.select("id", "dl", F.explode_outer("tokens").alias("term")).join(known, "term", "left")
    asked = F.coalesce(F.when(F.col("known"), F.col("term")), F.lit("")).alias("term")
    return words.groupBy("id", asked, "dl").agg(F.count(words["term"]).alias("tf"))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    """Index a chunk collection.

    Texts are tokenised once, into a table in the shared folder that lengths, postings and terms
    are derived from. Document frequencies come from each document's distinct terms, counted before
    the shuffle, and need no pass over the postings.
    """
    docs = write_through(_documents(chunks, id_col, text_col), "tokens", compression="zstd")
    terms = (
        each(docs, [], F.array_distinct("tokens"), "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return LexicalIndex(docs.select("id", "dl"), _postings(docs), terms, docs, (docs,))


def query_terms(queries: DataFrame, query_id: str = "query_id", text_col: str = "query") -> DataFrame:
    """``query_id, term, qtf``; repeated query terms count repeatedly."""
    return (
        each(queries, [F.col(query_id).alias("query_id")], tokenize(text_col), "term")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _score(
    wanted: DataFrame, postings: DataFrame, avgdl: Column, k1: float, b: float, small: bool, salts: int, asked: DataFrame, n_docs: int
) -> DataFrame:
    """Sum of term contributions per (query, document).

    Stored postings also join on their bucket; the test on ``qtf``, true of every row, lets the
    scan be pruned to the buckets asked for. The postings of the terms ``asked`` for are dealt out by document
    before they meet the queries, over so many tasks that each sums a bounded number of pairs in place.
    """
    keys = ["term"]
    if "bucket" in postings.columns:
        keys = ["bucket", "term"]
        wanted = wanted.where("qtf > 0").withColumn("bucket", term_bucket("term"))
        asked = asked.where("qtf > 0").withColumn("bucket", term_bucket("term"))
    if small:
        n_queries = asked.agg(F.count_distinct("query_id").alias("n")).first()["n"]
        if "bucket" in postings.columns:  # others are of asked terms already
            postings = postings.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
        dealt = postings.repartition(parts_for(postings, n_docs * n_queries, TASK_PAIRS), "id")
        hits = dealt.join(F.broadcast(wanted), keys)
    else:
        # too many query terms to send around: spread each term's postings over ``salts`` keys
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
        copies = wanted.withColumn("salt", F.explode(every))
        hits = salted.join(copies, [*keys, "salt"])
    part = F.col("qtf") * F.col("idf") * _weight(F.col("tf"), F.col("dl"), avgdl, k1, b)
    return (
        hits.groupBy("query_id", "id")
        .agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
        .where("score > 0")
    )


def search(
    index: LexicalIndex,
    queries: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    text_col: str = "query",
    k1: float = C.BM25_K1,
    b: float = C.BM25_B,
    broadcast_bytes: int = 64 << 20,
    salts: int = 64,
) -> DataFrame:
    """Top ``k`` documents per query from a stored index: ``query_id, id, score, rank``."""
    asked = query_terms(queries, query_id, text_col)
    small = fits_broadcast(asked, broadcast_bytes)
    wanted = asked.join(index.idf(), "term")
    avgdl = index.lengths.select(F.avg("dl")).scalar()
    return top_k(_score(wanted, index.postings, avgdl, k1, b, small, salts, asked, index.lengths.count()), k)


def search_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "chunk_id",
    text_col: str = "text",
    query_id: str = "query_id",
    query_col: str = "query",
    k1: float = C.BM25_K1,
    b: float = C.BM25_B,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Top ``k`` per query straight from texts, for collections that are asked once.

    Only tokens of the query vocabulary leave their document one by one; the rest are counted
    in place. The texts are read and tokenised once: one shuffle of postings serves the mean
    length, the document frequencies and the scoring.
    """
    asked = query_terms(queries, query_id, query_col)
    if not fits_broadcast(asked, broadcast_bytes):
        index = build_index(chunks, id_col, text_col)
        return search(index, queries, k, query_id, query_col, k1, b, broadcast_bytes)
    size = chunks.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col).cast("bigint")).alias("bytes")).first()
    parts = parts_for(chunks, size["bytes"] or 0, TASK_BYTES)
    if chunks.rdd.getNumPartitions() < parts:
        chunks = chunks.select(id_col, text_col).repartition(parts)
    docs = _documents(chunks, id_col, text_col)
    postings = _asked_postings(docs, asked.select("term").distinct())
    n_docs = F.lit(size["n"])
    # asked terms always have a positive count; naming it keeps this branch equal to the scored
    # one, so that both read the same shuffle
    terms = postings.groupBy("term").agg(
        F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf")
    )
    # the window spans the asked vocabulary, whose size was checked above
    sized = terms.withColumn("n_tokens", F.sum("cf").over(Window.partitionBy()))
    wanted = asked.join(sized, "term").select(
        "query_id",
        "term",
        "qtf",
        idf(n_docs, F.col("df")).alias("idf"),
        (F.col("n_tokens") / n_docs).alias("avgdl"),
    )
    return top_k(_score(wanted, postings, F.col("avgdl"), k1, b, True, 1, asked, size["n"]), k)

