"""Financial indicators, keywords and names taken from chunk texts and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import as_col, format_text, let, strip, text_array


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    # the captured value is never empty, so an empty result means no match
    found = F.regexp_extract(text, "(?U)" + pattern, group)
    return F.when(found != "", found)


def _kind(indicator: str) -> str:
    if indicator in C.AMOUNT_INDICATORS:
        return "amount"
    return "percent" if indicator in C.PERCENT_INDICATORS else "per_share"


def _amount_unit(text: Column, pattern: str) -> Column:
    # the unit may stand in the match or in the few characters after it
    span = F.regexp_extract(text, rf"(?Us)(?:{pattern}).{{0,{C.UNIT_LOOKAHEAD}}}", 0)
    return (
        F.when(span.contains("亿"), "亿元")
        .when(span.contains("万"), "万元")
        .when(span.contains("元"), "元")
        .otherwise("")
    )


def indicator_candidates(text: Column | str) -> Column:
    """First match of every indicator pattern: array of ``pattern_no, indicator, value, unit``.

    Reads the whole text.
    """
    text = as_col(text)
    found = []
    for number, (pattern, indicator) in enumerate(C.INDICATOR_PATTERNS):
        kind = _kind(indicator)
        unit = {"amount": _amount_unit(text, pattern), "percent": F.lit("%"), "per_share": F.lit("元")}
        value = _first(text, pattern)
        found.append(
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(number).alias("pattern_no"),
                    F.lit(indicator).alias("indicator"),
                    value.alias("value"),
                    unit[kind].alias("unit"),
                ),
            )
        )
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def first_per_indicator(candidates: Column | str) -> Column:
    """Keep the first candidate of every indicator, inside the row."""

    def firsts(found: Column) -> Column:
        names = F.transform(found, lambda s: s["indicator"])
        return let(
            names, lambda n: F.filter(found, lambda s, i: F.array_position(n, s["indicator"]) == i + 1)
        )

    return let(candidates, firsts)


def values_with_unit(text: Column | str) -> Column:
    """First value with its unit per indicator: array of ``indicator, value, unit``."""
    text = as_col(text)
    found = []
    for pattern, indicator in C.VALUE_WITH_UNIT_PATTERNS:
        value = strip(_first(text, pattern))
        unit = F.lit("")
        for name in reversed(C.UNITS):
            unit = F.when(value.contains(name), name).otherwise(unit)
        found.append(
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(indicator).alias("indicator"), value.alias("value"), unit.alias("unit")
                ),
            )
        )
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def all_values(text: Column | str) -> Column:
    """Every value per indicator: array of ``indicator, ord, value``.

    Patterns without a unit group yield the bare number.
    """
    text = as_col(text)
    groups = []
    for pattern, indicator in C.ALL_VALUE_PATTERNS:
        java = F.lit("(?U)" + pattern)
        values = F.regexp_extract_all(text, java, F.lit(1))
        if "(亿元|万元|元)" in pattern:
            values = F.zip_with(
                values, F.regexp_extract_all(text, java, F.lit(2)), lambda v, u: F.concat(v, u)
            )
        groups.append(
            F.transform(
                values,
                lambda v, i: F.struct(
                    F.lit(indicator).alias("indicator"), i.alias("ord"), v.alias("value")
                ),
            )
        )
    return F.concat(*groups)


def indicator_flags(text: Column | str) -> Column:
    """Names of the indicators of which a keyword occurs."""
    text = as_col(text)
    names = []
    for name, keywords in C.INDICATOR_KEYWORDS.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | text.contains(keyword)
        names.append(F.when(hit, name))
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def keyword_contexts(text: Column | str) -> Column:
    """Text around the first keyword of every indicator: array of ``indicator, context``."""
    text = as_col(text)
    found = []
    for name, keywords in C.CONTEXT_KEYWORDS.items():
        at = F.lit(0)
        for keyword in reversed(keywords):
            place = F.instr(text, keyword)
            at = F.when(place > 0, place).otherwise(at)
        start = F.greatest(at - C.CONTEXT_BEFORE, F.lit(1))
        window = F.substring(text, start, at + C.CONTEXT_AFTER - start)
        found.append(
            F.when(
                at > 0,
                F.struct(
                    F.lit(name).alias("indicator"),
                    strip(F.replace(window, F.lit("\n"), F.lit(" "))).alias("context"),
                ),
            )
        )
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def first_keyword(text: Column | str, keywords: list[str]) -> Column:
    """First keyword of the list, in list order, that occurs; NULL if none does."""
    text = as_col(text)
    return F.get(F.filter(text_array(keywords), lambda k: F.contains(text, k)), F.lit(0))


def summary_keyword(text: Column | str) -> Column:
    """Keyword that makes a chunk a summary candidate, NULL for short or other chunks."""
    text = as_col(text)
    return F.when(F.length(text) > C.SUMMARY_MIN_CHARS, first_keyword(text, C.SUMMARY_KEYWORDS))


def narrative_keywords(text: Column | str) -> Column:
    """Narrative keywords of a long chunk with at least three of them, NULL otherwise."""
    text = as_col(text)
    found = F.filter(text_array(C.NARRATIVE_KEYWORDS), lambda k: F.contains(text, k))
    usable = (F.length(text) >= C.NARRATIVE_MIN_CHARS) & ~text.startswith("[")
    return F.when(usable & (F.size(found) >= C.NARRATIVE_MIN_KEYWORDS), found)


def source_parts(source: Column | str) -> Column:
    return F.split(F.replace(as_col(source), F.lit(".pdf"), F.lit("")), "_")


def source_company(source: Column | str) -> Column:
    """Company part of a source name; empty for excluded or one-part names."""
    source = as_col(source)
    company = F.coalesce(F.get(source_parts(source), F.lit(1)), F.lit(""))
    return F.when(source.startswith(C.EXCLUDED_SOURCE_PREFIX), "").otherwise(company)


def source_metadata(source: Column | str) -> Column:
    """``industry, company, vendor, seq`` of a source name, NULL where parts are missing."""
    parts = source_parts(source)
    names = ["industry", "company", "vendor", "seq"]
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def enrich_chunk(text: Column, source: Column, page: Column) -> Column:
    """Put the company name in front and the origin behind a chunk to lift lexical recall.

    Chunks whose source names no company stay as they are.
    """
    company = F.coalesce(F.get(source_parts(source), F.lit(1)), F.lit(""))
    enriched = format_text(
        "{c} {c} 【公司：{c}】 {text} 【来源：{source} 页码：{page}】",
        c=company, text=text, source=source, page=page,
    )
    return F.when(company == "", text).otherwise(enriched)


def fact_question(doc: Column, page: Column, company: Column, indicator: Column, unit: Column) -> Column:
    """Question text; the unit is named unless it is a share."""
    slots = {"doc": doc, "page": page, "company": company, "indicator": indicator}
    plain = format_text(C.QUESTION_TEMPLATE, **slots)
    with_unit = format_text(C.QUESTION_TEMPLATE_UNIT, **slots, unit=unit)
    return F.when(unit.isin("亿元", "万元"), with_unit).otherwise(plain)
