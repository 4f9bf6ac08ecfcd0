"""Heading tests and overlap tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import as_col, strip

_VARIANTS = {
    "chunker": (C.TITLE_PATTERNS_CHUNKER, C.TITLE_MAX_CHARS),
    "layout": (C.TITLE_PATTERNS_LAYOUT, C.TITLE_MAX_CHARS),
    "page": (C.TITLE_PATTERNS_PAGE, None),
}


def is_title(text: Column | str, variant: str = "chunker") -> Column:
    """True for heading-like text; ``page`` puts no bound on the length."""
    patterns, limit = _VARIANTS[variant]
    body = strip(text)
    matched = body.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    if limit is None:
        return matched
    return (F.length(body) <= limit) & matched


def overlap_tail(text: Column | str, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Last ``overlap`` characters, restarted after the last sentence end inside them.

    A sentence end in the very first position does not count.
    """
    text = as_col(text)
    tail = F.right(text, F.lit(overlap))
    ends = "".join(C.SENTENCE_ENDINGS)
    after_end = F.regexp_extract(tail, rf"(?s)^.+[{ends}]([^{ends}]*)$", 1)
    cut = F.when(tail.rlike(rf"(?s)^.+[{ends}][^{ends}]*$"), after_end).otherwise(tail)
    return F.when(F.length(text) <= overlap, text).otherwise(cut)
