"""Page geometry. Boxes are structs ``x0, y0, x1, y1`` with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import as_col
from paperloom.functions.titles import is_title


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
    )


def layout_type(boxes: Column | str, page_width: Column | float) -> Column:
    """``double_column`` when more than three boxes are centred on each side."""
    boxes = as_col(boxes)
    middle = (page_width if isinstance(page_width, Column) else F.lit(page_width)) / 2
    left = F.size(F.filter(boxes, lambda b: (b["x0"] + b["x1"]) / 2 < middle))
    right = F.size(boxes) - left
    return F.when((left > 3) & (right > 3), "double_column").otherwise("single_column")


def _zone(y0: Column, y1: Column, height: Column) -> Column:
    return F.when(y1 < height * F.lit(C.HEADER_SHARE), "header").when(
        y0 > height * F.lit(1 - C.FOOTER_SHARE), "footer"
    )


def block_type(bbox: Column, text: Column, page_height: Column) -> Column:
    """Header, footer, title or text."""
    zone = _zone(bbox["y0"], bbox["y1"], page_height)
    return F.coalesce(zone, F.when(is_title(text, "layout"), "title"), F.lit("text"))


def region_type(bbox: Column, page_width: Column, page_height: Column) -> Column:
    """Region class from the geometry alone: flat and wide is a table."""
    width = bbox["x1"] - bbox["x0"]
    height = bbox["y1"] - bbox["y0"]
    flat = ~(height > width * 0.3)
    return F.coalesce(
        _zone(bbox["y0"], bbox["y1"], page_height),
        F.when(flat & (width > page_width * 0.8), "table"),
        F.lit("text"),
    )


def is_content(bbox: Column, page_height: Column) -> Column:
    return _zone(bbox["y0"], bbox["y1"], page_height).isNull()


def content_blocks(blocks: Column | str) -> Column:
    """Blocks that are neither header nor footer."""
    return F.filter(as_col(blocks), lambda b: ~b["block_type"].isin("header", "footer"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes that only touch do not overlap."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])

    def area(c: Column) -> Column:
        return (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])

    shared = wide * high
    union = area(a) + area(b) - shared
    return F.when((wide > 0) & (high > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def merge_boxes(boxes: Column | str) -> Column:
    """Smallest box around all boxes of an array."""
    boxes = as_col(boxes)

    def side(name: str) -> Column:
        return F.transform(boxes, lambda b: b[name])

    return F.when(
        F.size(boxes) > 0,
        box(
            F.array_min(side("x0")),
            F.array_min(side("y0")),
            F.array_max(side("x1")),
            F.array_max(side("y1")),
        ),
    )
