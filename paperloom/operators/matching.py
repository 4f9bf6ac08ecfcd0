"""Joins that locate answers in chunks, build evaluation samples and track processed input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.answers import answer_in_text, comma_free_contains, numbers
from paperloom.functions.extraction import source_company
from paperloom.functions.strings import as_col, format_text
from paperloom.operators.numbering import numbered
from paperloom.operators.ranking import keep_first
from paperloom.operators.rows import each
from paperloom.session import fits_broadcast, write_through


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not processed yet."""
    return items.join(done.select(key), key, "left_anti")


def lookup(ids: DataFrame, chunks: DataFrame, key: str = "chunk_id", how: str = "left") -> DataFrame:
    """Chunk data for ids, NULL for unknown ones (or without them, ``how="inner"``).

    Ids are few against chunks, so they are written once, and where their measured size allows it sent to
    the tasks that scan the chunks: texts are filtered in place and only the wanted ones move. More ids
    than that meet the chunks in a shuffled join; the rows are the same.
    """
    ids = write_through(ids, "ids")
    wanted = ids.select(key).distinct()
    if fits_broadcast(wanted):
        chunks = chunks.join(F.broadcast(wanted), key, "left_semi")
    return ids.join(chunks, key, how)


def _salted_join(samples: DataFrame, chunks: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Equi-join whose keys may be very uneven on the chunk side."""
    left = samples.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = chunks.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def answer_values(answer: Column | str) -> Column:
    """Numbers of an answer; without any, its first clause of over four characters or its head."""
    answer = as_col(answer)
    found = F.array_distinct(numbers(answer, r"[\d,.]+"))
    clause = F.get(F.filter(F.split(answer, "，"), lambda c: F.length(c) > 4), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(clause, F.left(answer, F.lit(8)))))


def remap_truth(samples: DataFrame, chunks: DataFrame, salts: int = 8) -> DataFrame:
    """Find the chunk that holds the answer of every sample.

    ``samples``: ``query_id, source_file, page_num, company, answer``. A chunk matches if its
    source and page agree and its text contains any value of the answer, commas aside; without
    such a chunk one from the same company and page is taken. The smallest chunk id wins.
    Unmatched samples stay, with a NULL ``chunk_id``, so that nobody divides by too few. The
    values and the first matches are written to the shared folder, since later steps read them
    again.
    """
    place = ["query_id", "source_file", "company", F.col("page_num").cast("string").alias("page")]
    wanted = write_through(each(samples, place, answer_values("answer"), "value"), "answer-values")
    placed = chunks.select(
        "chunk_id",
        F.col("source").alias("source_file"),
        source_company("source").alias("company"),
        F.col("page_num").cast("string").alias("page"),
        "text",
    )

    def located(left: DataFrame, key: str, name: str) -> DataFrame:
        other = "company" if key == "source_file" else "source_file"
        # each place and value is looked up once, however many samples share it
        keys = [key, "page", "value"]
        pairs = _salted_join(left.select(*keys).distinct(), placed.drop(other), [key, "page"], salts)
        holds = comma_free_contains(F.col("text"), F.col("value"))
        first = pairs.where(holds).groupBy(*keys).agg(F.min("chunk_id").alias(name))
        return left.select("query_id", *keys).join(first, keys).groupBy("query_id").agg(F.min(name).alias(name))

    exact = write_through(located(wanted, "source_file", "by_file"), "matched-by-file")
    fallback = located(wanted.join(exact, "query_id", "left_anti"), "company", "by_company")
    found = samples.select("query_id").join(exact, "query_id", "left").join(fallback, "query_id", "left")
    how = F.when(F.col("by_file").isNotNull(), "file").when(F.col("by_company").isNotNull(), "company")
    return found.select(
        "query_id", F.coalesce("by_file", "by_company").alias("chunk_id"), how.alias("matched_by")
    )


def verify_samples(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Check samples against their chunk: answer, source and page agree."""
    joined = samples.join(
        chunks.select("chunk_id", "text", "source", F.col("page_num").alias("chunk_page")), "chunk_id", "left"
    )
    return joined.select(
        "query_id",
        F.col("text").isNotNull().alias("chunk_found"),
        F.coalesce(answer_in_text("text", "answer"), F.lit(False)).alias("answer_ok"),
        F.coalesce(F.col("source") == F.col("source_file"), F.lit(False)).alias("source_ok"),
        F.coalesce(F.col("chunk_page").cast("string") == F.col("page_num").cast("string"), F.lit(False)).alias("page_ok"),
    )


def seeded_key(seed: int, *ids: Column) -> Column:
    """Reproducible pseudo-random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))


def sample_seeded(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order."""
    return df.orderBy(seeded_key(seed, F.col(id_col)), id_col).limit(n)


def split_by_share(df: DataFrame, id_col: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Label rows by seeded shares, row by row and without a shuffle."""
    point = F.conv(F.substring(seeded_key(seed, F.col(id_col)), 1, 8), 16, 10).cast("double") / float(16**8)
    label, upper = None, 0.0
    for name, share in shares[:-1]:
        upper += share
        label = F.when(point < upper, name) if label is None else label.when(point < upper, name)
    return df.withColumn("split", label.otherwise(shares[-1][0]))


def comparison_pairs(facts: DataFrame, seed: int = 42, digits: int = 2) -> DataFrame:
    """Pair companies that report the same indicator, each company at most once per indicator.

    ``facts``: ``company, indicator``. Companies are spread over buckets by hash and joined with
    their neighbour there, so the work is linear and no indicator's companies meet in one task.
    """
    distinct = facts.select("company", "indicator").distinct()
    placed = distinct.withColumn("key", seeded_key(seed, F.col("company"))).withColumn(
        "bucket", F.substring("key", 1, digits)
    )
    order = Window.partitionBy("indicator", "bucket").orderBy("key", "company")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1)
    pair = F.floor(F.col("place") / 2)
    pairs = numbered.groupBy("indicator", "bucket", pair.alias("pair")).agg(
        F.min("company").alias("first"), F.max("company").alias("second"), F.count("*").alias("n")
    )
    question = format_text(C.COMPARISON_TEMPLATE, first="first", second="second", indicator="indicator")
    return pairs.where("n = 2").select("indicator", "first", "second", question.alias("query"))


def indicator_pairs(facts: DataFrame, seed: int = 42) -> DataFrame:
    """Pairs of all companies that report an indicator; of an odd number one company stays alone.

    ``facts``: ``company, indicator, answer, source``. Companies are numbered in seeded order over ranges of
    bounded size, so neighbours pair across ranges too and no indicator's companies meet in one task. Each side
    brings the answer and source of its smallest fact, by source and then answer.
    """
    one = facts.where("company IS NOT NULL AND indicator IS NOT NULL").groupBy("company", "indicator").agg(F.min(F.struct("source", "answer")).alias("fact"))
    rows = one.select(F.concat(F.lit("="), "indicator").alias("grp"), "indicator", "company", seeded_key(seed, F.col("company")).alias("key"), "fact")
    placed = numbered(rows, "grp", ["key", "company"]).withColumn("second", F.col("pos") % 2 == 1)
    sides = placed.groupBy("grp", F.expr("pos div 2").alias("pair")).agg(
        F.first("indicator").alias("indicator"), F.count("*").alias("n"),
        *[F.max(F.when(F.col("second") == late, F.col(c))).alias(f"{name}_{c}") for name, late in (("first", False), ("second", True)) for c in ("company", "fact")],
    )
    question = format_text(C.COMPARISON_TEMPLATE, first="first_company", second="second_company", indicator="indicator")
    answer = F.concat("first_company", F.lit(": "), "first_fact.answer", F.lit("\n"), "second_company", F.lit(": "), "second_fact.answer")
    source = F.concat_ws("; ", "first_fact.source", "second_fact.source")
    return sides.where("n = 2").select("indicator", F.col("first_company").alias("first"), F.col("second_company").alias("second"), question.alias("query"), answer.alias("answer"), source.alias("source_file"))


def longest_context(contexts: DataFrame, order: list[Column]) -> DataFrame:
    """Longest context per company and indicator, first in the given order among equals."""
    return keep_first(contexts, ["company", "indicator"], [F.desc(F.length("context")), *order])


def company_summary(documents: DataFrame) -> DataFrame:
    """Per company: files, pages, tables and the indicators seen.

    ``documents``: ``source, company, n_pages, n_tables, indicators``. The indicator set is
    bounded by the indicator table; files are counted, not collected.
    """
    totals = documents.groupBy("company").agg(
        F.count("*").alias("n_files"),
        F.sum("n_pages").alias("total_pages"),
        F.sum("n_tables").alias("total_tables"),
    )
    flags = each(documents, ["company"], "indicators", "indicator").distinct()
    named = flags.groupBy("company").agg(F.array_sort(F.collect_list("indicator")).alias("indicators"))
    joined = totals.join(named, "company", "left").withColumn(
        "indicators", F.coalesce("indicators", F.array().cast("array<string>"))
    )
    usable = (
        (F.size("indicators") > 0)
        & (F.col("n_files") >= C.COMPANY_MIN_FILES)
        & ~F.col("company").isin(C.COMPANY_BLOCKLIST)
    )
    return joined.withColumn("usable", usable)


def latest_entries(log: DataFrame, key: str, order: list[Column], capacity: int = C.CACHE_ENTRIES) -> DataFrame:
    """Content of a response cache after replaying an access log: last entry per key, newest keys."""
    return keep_first(log, [key], order).orderBy(*order).limit(capacity)
