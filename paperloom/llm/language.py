"""Language identification by multilingual mixture inference.

A language is a distribution over hashed letter trigrams, learned from labelled rows. Each
text is taken for a mixture of languages whose proportions are estimated by expectation
maximisation. Language sets grow in order of proportion, and a set is charged ``penalty`` times
half the logarithm of the number of trigrams for each language, so that a further language must
earn its place. The prediction is the largest proportion of the chosen set, its score that proportion.

Learning uses a bounded sample (``per_language`` expected rows of each language, picked by a hash
of the key) of rows with a label that are not held out. Everything else covers all rows.

Cases: a NULL text or one without letters is ``und`` with score 0, and so is any text if nothing
could be learned. A NULL key is not held out and not learned from. Ties go to the language
first in order. Repeated rows are each predicted; an empty table gives no rows; other columns
are ignored (or kept by ``keep_known``).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, fresh, register, ship, table

UNKNOWN = "und"
BUCKETS = 1 << 16


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's trigrams; what is no letter counts as one space. Empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    known = _letters()[codes]
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.where(known, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = known[1:] | known[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def _counted(batches):
    import pandas as pd

    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            found, counts = trigrams(text)
            sums.setdefault(lang, np.zeros(BUCKETS))[found] += counts
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found].astype(np.int64)})


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 3000, kinds: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities, one column per language.

    The sample is bounded by ``per_language`` expected rows of each of the ``kinds`` most frequent labels, which
    bounds the model as well.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(kinds).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    steps = 1 << 20
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(steps, -(-steps * per_language // sizes[k])))])
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(steps)) < F.try_element_at(share, F.col("lang"))).select("lang", "text")
    ship(documents.sparkSession)
    counts = picked.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((BUCKETS, len(langs)), 0.5)
    np.add.at(matrix, (counts["bucket"].to_numpy(int), np.searchsorted(langs, counts["lang"].to_numpy(str)) if len(counts) else np.zeros(0, int)), counts["n"].to_numpy(float))
    return langs, matrix / matrix.sum(axis=0)


def proportions(chances: np.ndarray, counts: np.ndarray, rounds: int = 40, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Expectation maximisation of the mixture weights; the weights and the log likelihood."""
    total = counts.sum()
    weights = np.full(chances.shape[1], 1.0 / chances.shape[1])
    for _ in range(rounds if len(weights) > 1 else 0):
        before, weights = weights, weights * (chances.T @ (counts / (chances @ weights))) / total
        if np.abs(weights - before).max() < tolerance:
            break
    return weights, float(counts @ np.log(chances @ weights))


def mixture(model: np.ndarray, text: str | None, penalty: float = 4.0, least: float = 0.02) -> tuple[np.ndarray, np.ndarray] | None:
    """Chosen languages (columns of the model) and their proportions, largest first; None without letters."""
    found, counts = trigrams(text)
    if not len(found) or not model.shape[1]:
        return None
    chances = model[found]
    weights, _ = proportions(chances, counts)
    order = np.argsort(-weights, kind="stable")
    charge = penalty * 0.5 * np.log(counts.sum() + 1)
    best, chosen = -np.inf, None
    for size in range(1, max(1, int((weights > least).sum())) + 1):
        part, fit = proportions(chances[:, order[:size]], counts)
        if fit - charge * size > best:
            best, chosen = fit - charge * size, (order[:size], part)
    places, part = chosen
    rank = np.argsort(-part, kind="stable")
    return places[rank], part[rank]


def predictor(langs: list[str], model: np.ndarray, spark):
    """Column function: struct of ``lang``, ``score`` and ``langs`` (the chosen set, largest first)."""
    shared = spark.sparkContext.broadcast((langs, model))

    def predict(texts: pa.Array) -> pa.Array:
        names, chances = shared.value
        rows = []
        for text in texts:
            found = mixture(chances, text.as_py())
            if found is None:
                rows.append({"lang": UNKNOWN, "score": 0.0, "langs": []})
            else:
                chosen = [names[i] for i in found[0]]
                rows.append({"lang": chosen[0], "score": min(1.0, float(found[1][0])), "langs": chosen})
        return pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string()))]))

    return arrow(predict, "struct<lang string, score double, langs array<string>>")


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score, languages`` of every row."""
    langs, model = learn(documents, key, text, lang)
    found = documents.select(F.col(key), predictor(langs, model, documents.sparkSession)(F.col(text)).alias("p"))
    return found.select(key, held_out(F.col(key)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.langs").alias("languages"))


def keep_known(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows whose main language is one of ``languages`` (all learned ones if None) and makes up ``least`` of the text.

    Texts without letters are ``und`` and go, as do those mixed so that no language has that share. A NULL label is
    filled with the prediction; all other columns stay as they are.
    """
    name = fresh(documents, "predicted")
    langs, model = learn(documents, key, text, lang)
    marked = documents.withColumn(name, predictor(langs, model, documents.sparkSession)(F.col(text)))
    wanted = F.col(name)["lang"] != UNKNOWN if languages is None else F.col(name)["lang"].isin(languages)
    filled = {lang: F.coalesce(F.col(lang), F.col(name)["lang"]).alias(lang)}
    return marked.where(wanted & (F.col(name)["score"] >= least)).select(*[filled.get(c, F.col(c)) for c in documents.columns])


@register("op6_language")
def op6_language(spark, folder):
    """Predicted language of every document."""
    return identify(table(spark, folder, "documents"))
