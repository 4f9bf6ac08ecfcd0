"""Whole-document text from the pages of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import as_col, format_text



def _mark(page: Column) -> Column:
    return format_text(C.PAGE_MARK, page=page["page_num"])


def full_text(pages: Column | str) -> Column:
    """Page marks and block texts; pages are structs ``page_num, texts``."""
    parts = F.transform(
        as_col(pages), lambda p: F.concat(_mark(p), F.lit("\n"), F.array_join(p["texts"], "\n"))
    )
    return F.array_join(parts, "\n")


def full_text_with_tables(pages: Column | str) -> Column:
    """Page marks, content blocks without headers and footers, then the tables as Markdown.

    Pages are structs ``page_num, text_blocks, tables``.
    """

    def page(p: Column) -> Column:
        solid = F.filter(p["text_blocks"], lambda b: ~b["block_type"].isin("header", "footer"))
        texts = F.transform(solid, lambda b: F.concat(b["text"], F.lit("\n")))
        tables = F.transform(p["tables"], lambda t: F.concat(F.lit(C.TABLE_MARK), t["markdown"], F.lit("\n")))
        return F.concat(_mark(p), F.array_join(texts, ""), F.array_join(tables, ""))

    return F.array_join(F.transform(as_col(pages), page), "\n")
