"""Checks on generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions.strings import any_contains, as_col, format_text, let


def numbers(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit("(?U)" + pattern), F.lit(0))


def _missing(found: Column, context: Column) -> Column:
    return F.filter(found, lambda n: ~F.contains(context, n))


def hallucination(answer: Column | str, context: Column | str) -> Column:
    """``score, unverified_numbers, unverified_dates, has_citation, is_hallucination``."""
    answer = as_col(answer)
    return let(F.coalesce(as_col(context), F.lit("")), lambda text: let(
        F.struct(
            _missing(numbers(answer, C.NUMBER_IN_ANSWER), text).alias("numbers"),
            _missing(numbers(answer, C.DATE_IN_ANSWER), text).alias("dates"),
        ),
        lambda bad: _judged(answer, bad["numbers"], bad["dates"]),
    ))


def _judged(answer: Column, bad_numbers: Column, bad_dates: Column) -> Column:
    cited = any_contains(answer, C.CITATION_MARKS)
    # tenths as integers: the limit is strict and must not depend on float rounding
    tenths = (
        F.when(F.size(bad_numbers) > 0, round(C.UNVERIFIED_NUMBER_WEIGHT * 10)).otherwise(0)
        + F.when(F.size(bad_dates) > 0, round(C.UNVERIFIED_DATE_WEIGHT * 10)).otherwise(0)
        + F.when(
            ~cited & (F.length(answer) > C.NO_CITATION_MIN_CHARS), round(C.NO_CITATION_WEIGHT * 10)
        ).otherwise(0)
    )
    return F.struct(
        (tenths / 10).alias("score"),
        bad_numbers.alias("unverified_numbers"),
        bad_dates.alias("unverified_dates"),
        cited.alias("has_citation"),
        (tenths > round(C.HALLUCINATION_LIMIT * 10)).alias("is_hallucination"),
    )


def verify(answer: Column | str, context: Column | str) -> Column:
    """``trusted`` and the ``reason``."""
    found = hallucination(answer, context)
    bad = found["is_hallucination"]
    uncited = ~found["has_citation"]
    reason = (
        F.when(bad, C.VERIFY_HALLUCINATION).when(uncited, C.VERIFY_NO_CITATION).otherwise(C.VERIFY_TRUSTED)
    )
    return F.struct((~bad & ~uncited).alias("trusted"), reason.alias("reason"))


def with_warning(answer: Column, is_hallucination: Column) -> Column:
    return F.when(is_hallucination, F.concat(answer, F.lit(C.HALLUCINATION_WARNING))).otherwise(answer)


def is_refusal(answer: Column | str) -> Column:
    return any_contains(answer, C.REFUSAL_PHRASES)


def cites(answer: Column | str, rank: Column | str) -> Column:
    """True if the answer carries the citation mark of that rank."""
    mark = F.concat(F.lit("[Source "), as_col(rank).cast("string"), F.lit("]"))
    return F.contains(as_col(answer), mark)


def preview(text: Column | str) -> Column:
    return F.concat(F.left(as_col(text), F.lit(C.PREVIEW_CHARS)), F.lit("..."))


def hit_score(*scores: Column) -> Column:
    """First score that is neither NULL nor zero, else zero."""
    return F.coalesce(*[F.when(s != 0, s) for s in scores], F.lit(0.0))


def confidence(answer: Column, mean_score: Column) -> Column:
    """Mean score capped at one; zero for refusals and for answers without documents."""
    return F.when(is_refusal(answer), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(mean_score, F.lit(0.0))))


def context_entry(rank: Column, source: Column, page: Column, text: Column) -> Column:
    return format_text(C.CONTEXT_ENTRY, rank=rank, source=source, page=page, text=text)


def prompt(context: Column, question: Column) -> Column:
    return format_text(C.QA_PROMPT, context=context, question=question)


def mock_answer(question: Column | str) -> Column:
    """Answer of the built-in stand-in generator."""
    return format_text(C.MOCK_ANSWER, head=F.left(as_col(question), F.lit(100)))


def _plain(values: Column) -> Column:
    return F.transform(values, lambda n: F.regexp_replace(n, r"[, ]", ""))


def same_number(expected: Column | str, actual: Column | str) -> Column:
    """True if any number of the expected answer occurs in the actual one, commas aside."""
    return F.arrays_overlap(_plain(numbers(expected, r"[\d,.]+")), _plain(numbers(actual, r"[\d,.]+")))


def same_amount(expected: Column | str, actual: Column | str) -> Column:
    """Stricter: numbers keep their unit and the expected one needs more than three characters."""
    pattern = r"[\d,.]+\s*(?:亿元|万元|元|%)?"
    wanted = F.filter(numbers(expected, pattern), lambda n: F.length(n) > 3)
    return F.arrays_overlap(_plain(wanted), _plain(numbers(actual, pattern)))


def answer_in_text(text: Column | str, answer: Column | str) -> Column:
    """Answer, answer without commas, or its first number (either form) contained in the text."""
    text, answer = as_col(text), as_col(answer)
    number = F.regexp_extract(answer, r"(?U)[\d,]+(?:\.\d+)?", 0)

    def plain(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(""))

    return (
        F.contains(text, answer)
        | F.contains(text, plain(answer))
        | ((number != "") & (F.contains(text, number) | F.contains(text, plain(number))))
    )


def digits_in_text(text: Column | str, answer: Column | str) -> Column:
    """Answer itself or its projection to digits, dots and percent signs contained in the text."""
    text, answer = as_col(text), as_col(answer)
    return F.contains(text, answer) | F.contains(text, F.regexp_replace(answer, r"(?U)[^\d.%]", ""))


def comma_free_contains(text: Column, value: Column) -> Column:
    return F.contains(F.replace(text, F.lit(","), F.lit("")), F.replace(value, F.lit(","), F.lit("")))


def overlap_metrics(question: Column, answer: Column, contexts: Column, truth: Column) -> Column:
    """Word-overlap answer metrics: faithfulness, relevancy, precision and recall of the context.

    All arguments are word sets; ``contexts`` is an array of them. Recall is NULL without truth.
    """

    def share(a: Column, b: Column) -> Column:
        return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))

    def metrics(sets: Column) -> Column:
        asked, found = sets["question"], sets["contexts"]
        total = F.aggregate(found, F.lit(0.0), lambda acc, c: acc + share(asked, c))
        precision = F.when(F.size(found) > 0, total / F.size(found)).otherwise(F.lit(0.0))
        return F.struct(
            share(sets["answer"], sets["joined"]).alias("faithfulness"),
            share(asked, sets["answer"]).alias("relevancy"),
            precision.alias("context_precision"),
            F.when(sets["truth"].isNotNull(), share(sets["truth"], sets["joined"])).alias("context_recall"),
        )

    joined = F.array_distinct(F.flatten(contexts))
    names = {"question": question, "answer": answer, "contexts": contexts, "truth": truth, "joined": joined}
    return let(F.struct(*[c.alias(n) for n, c in names.items()]), metrics)
