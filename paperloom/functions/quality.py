"""Detection of broken text extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.strings import as_col, let, without_space

_CID = r"\(cid\s*:\s*\d+\s*\)"
_PRIVATE_BMP = r"\x{E000}-\x{F8FF}"
_STRICT = (
    rf"[{_PRIVATE_BMP}\x{{F0000}}-\x{{FFFFF}}\x{{100000}}-\x{{10FFFF}}\x{{FFFD}}"
    r"\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9F\p{Cn}\p{Cs}]"
)
_BASIC = rf"[{_PRIVATE_BMP}\x{{FFFD}}]"
_SUBSET_FONT = r"^[A-Z0-9]{2,6}\+"
_CJK_CHAR = (
    r"^[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]"
)
_PUNCT_CHAR = r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def garbled_share(text: Column | str, basic: bool = False) -> Column:
    """Share of unreadable characters among the non-blank ones; NULL when there are none."""
    body = without_space(text)
    bad = F.regexp_count(body, F.lit(_BASIC if basic else _STRICT))
    return F.try_divide(bad.cast("double"), F.length(body))


def is_garbled(text: Column | str, threshold: float = 0.5) -> Column:
    """Full test: unmapped glyph marks, private-use, control and unassigned characters."""
    text = as_col(text)
    share = F.coalesce(garbled_share(text), F.lit(0.0))
    readable = F.length(without_space(text)) > 0
    return F.coalesce(readable & (text.rlike(_CID) | (share >= threshold)), F.lit(False))


def is_garbled_basic(text: Column | str, threshold: float = 0.3) -> Column:
    """Short test: unmapped glyph marks, BMP private-use and replacement characters only."""
    text = as_col(text)
    share = F.coalesce(garbled_share(text, basic=True), F.lit(-1.0))
    return F.coalesce(text.rlike(_CID) | (share >= threshold), F.lit(False))


def font_encoding_issue(chars: Column | str, min_chars: int = 20) -> Column:
    """Subset fonts whose output is punctuation only.

    ``chars`` is an array of structs with ``text`` and ``fontname``.
    """
    chars = as_col(chars)
    solid = F.filter(chars, lambda c: F.length(without_space(c["text"])) > 0)

    def broken(marks: Column) -> Column:
        total = F.size(marks)
        subset = F.size(F.filter(marks, lambda c: c["fontname"].rlike(_SUBSET_FONT)))
        cjk = F.size(F.filter(marks, lambda c: c["text"].rlike(_CJK_CHAR)))
        punct = F.size(F.filter(marks, lambda c: c["text"].rlike(_PUNCT_CHAR)))
        return (
            (total >= min_chars)
            & (subset / total >= 0.3)
            & (cjk / total < 0.05)
            & (punct / total > 0.4)
        )

    return F.coalesce(let(solid, broken), F.lit(False))


def visible_char(char: Column) -> Column:
    """False for white-on-white marks: both grey colours start with 1 and the text is a mark."""
    white = (
        (char["ncs"] == "DeviceGray")
        & (F.get(char["stroking_color"], F.lit(0)) == 1)
        & (F.get(char["non_stroking_color"], F.lit(0)) == 1)
        & char["text"].rlike(r"^[a-zT_\[\]\(\)-]+")
    )
    return ~F.coalesce(white, F.lit(False))


def text_with_ocr(blocks: Column, chars: Column, ocr_blocks: Column, threshold: float = 0.3) -> Column:
    """Replace a page's blocks by its OCR blocks when the extracted text is broken.

    The decision reads every block of the page.
    """
    sample = F.array_join(F.transform(blocks, lambda b: b["text"]), "")
    broken = is_garbled(sample, threshold) | font_encoding_issue(chars)
    return F.when(broken & (F.coalesce(F.size(ocr_blocks), F.lit(0)) > 0), ocr_blocks).otherwise(blocks)
