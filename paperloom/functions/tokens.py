"""Tokens for the lexical index and word sets for the overlap measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import as_col, text_array


def _segment_pattern() -> str:
    # Longest dictionary entry first, any single character last: at each position the
    # alternation picks what forward maximum matching picks.
    words = [t for t in C.FINANCE_TERMS if len(t) <= C.SEGMENT_WINDOW and not t.isascii()]
    words.sort(key=len, reverse=True)
    return "|".join([*words, r"[一-鿿]"])


SEGMENT_PATTERN = _segment_pattern()
TOKEN_PATTERN = rf"(?U)[a-zA-Z]{{2,}}|\d+\.?\d*|{SEGMENT_PATTERN}"
_TERM_GATE = r"[一-鿿]|ROE|ROA|EBITDA|ETF"


def finance_terms(text: Column | str) -> Column:
    """Dictionary terms contained in the text, each once."""
    text = as_col(text)
    found = F.filter(text_array(C.FINANCE_TERMS), lambda t: F.contains(text, t))
    return F.when(text.rlike(_TERM_GATE), found).otherwise(F.array().cast("array<string>"))


def segment_cjk(text: Column | str) -> Column:
    """Forward maximum matching over the CJK runs of a text."""
    return F.regexp_extract_all(as_col(text), F.lit(SEGMENT_PATTERN), F.lit(0))


def tokenize(text: Column | str, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """Bag of index tokens: contained terms, words, numbers and CJK segments, less stopwords.

    One regular expression pass collects words, numbers and segments; a term that is also a
    segment is counted twice, as the ranking expects. A ``segmenter`` (array of CJK runs to
    array of words) replaces the built-in matching; its one-character words are dropped.
    """
    text = as_col(text)
    if segmenter is not None:
        plain = F.regexp_extract_all(text, F.lit(r"(?U)[a-zA-Z]{2,}|\d+\.?\d*"), F.lit(0))
        runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0))
        words = F.filter(segmenter(runs), lambda w: F.length(w) > 1)
        found = F.concat(F.transform(plain, F.lower), words)
        return F.concat(finance_terms(text), F.filter(found, lambda t: ~t.isin(C.STOPWORDS)))
    scanned = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)
    kept = F.filter(scanned, lambda t: ~t.isin(C.STOPWORDS))
    return F.concat(finance_terms(text), kept)


def word_set(text: Column | str) -> Column:
    """Distinct lower-cased whitespace words; empty for blank or missing text."""
    words = F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def hash_slots(tokens: Column, dim: int) -> Column:
    """Signed feature-hashing slots: slot + 1, negative when the sign digit is odd."""

    def slot(token: Column) -> Column:
        digest = F.md5(token.cast("binary"))
        index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim + 1
        odd = F.conv(F.substring(digest, 9, 1), 16, 10).cast("bigint") % 2 == 1
        return F.when(odd, -index).otherwise(index).cast("int")

    return F.transform(tokens, slot)
