"""Small string helpers shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Python's strip() also removes
_SPACE = r"[\s\x1c-\x1f]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once per row and use it several times, also inside lambdas."""
    return F.get(F.transform(F.array(as_col(value)), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(as_col(text), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), rf"(?U){_SPACE}+", "")


def any_contains(text: Column | str, needles: list[str]) -> Column:
    """True if the text contains at least one of the literal needles."""
    text = as_col(text)
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_cjk(text: Column | str) -> Column:
    return as_col(text).rlike(r"[一-鿿]")


def format_text(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(as_col(values[rest[start + 1 : end]]).cast("string"))
        rest = rest[end + 1 :]
    return F.concat(*parts)
