"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; those that pass their check
(octets, Luhn, number of digits) are always spans. Wider patterns propose more candidates: addresses
with ``(at)`` and ``(dot)``, numbers without ``+``, card numbers with other separators, IPv6.
Labelers vote on every candidate of both kinds: the base pattern (regex), a list of domain endings,
card prefixes or calling codes (gazetteer), key words before the candidate (context) and a check of its
form. Expectation maximisation estimates from the votes alone how often a kind's candidates are
real and how reliable each labeler is; the posteriors train a naive Bayes classifier over
votes and form, which decides on the candidates outside the base.

Both fits see only counts per combination of votes and form, a bounded number of rows aggregated by
Spark over all candidates of all texts. Texts are read twice and never shuffled. Offsets come from the
lengths of the pieces between matches, summed in two levels so that they cost little in texts
with very many matches.

Cases: a NULL text counts as empty; a text without spans has an empty list, whose digest is that of
''. Every row is judged by itself, so repeated rows, ties and NULL keys change nothing. An empty
table gives no rows; other columns are ignored (or kept by ``redact``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.strings import let
from paperloom.llm.base import fresh, register, table

KINDS = ["email", "ip", "card", "phone"]

# Base patterns. Possessive where what follows cannot match inside; a match may begin only where the
# plain pattern's leftmost match would, which keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z][./_]|[0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])(?![.-][0-9])",
}
#: A cheap test that a text may hold a match at all.
HINT = {
    ("base", "email"): lambda t: t.contains("@"),
    ("base", "ip"): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("base", "card"): lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    ("base", "phone"): lambda t: t.contains("+"),
    ("wide", "email"): lambda t: t.rlike(r"(?i)at[)\]}]"),
    ("wide", "ip"): lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("wide", "card"): lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}"),
    ("wide", "phone"): lambda t: t.rlike(r"[0-9]{2}[) .-] ?[0-9]{3}"),
}
# Gazetteers and key words. Fixed values.
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|jp|cn|in|br|ru)$",
    "ip": r"^(?:10|127|172|192|(?:2[0-2]|1[0-9]|[1-9])[0-9]|[1-9])\.|^(?:2[0-9a-fA-F]{3}|f[cdeCDE][0-9a-fA-F]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|44|49|7|39|31|41|43|61|81|86|91|55)\b|\+?\(?0|\(?[2-9][0-9]{2}\)?[ .-])",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel|kontakt|schreib\w*)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|adresse|direcci[oó]n|login from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|telefon|anruf\w*|t[eé]l[eé]phone|m[oó]vil|tel[eé]fono)\b",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WINDOW, GROUP = 40, 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column, longest: int = 19) -> Column:
    """The check digit rule for up to ``longest`` digits."""
    back = F.reverse(number)
    total = F.lit(0)
    for i in range(longest):
        digit = F.when(F.length(back) > i, F.substring(back, i + 1, 1).cast("int")).otherwise(0)
        total = total + (digit if i % 2 == 0 else F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: array of (start, end, text); offsets in code points, end exclusive."""

    def placed(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

        def located(step: Column) -> Column:
            groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(step) / GROUP).cast("int")), lambda g: total(F.slice(step, g * GROUP + 1, F.lit(GROUP))))

            def spans(before: Column) -> Column:
                def span(h: Column, i: Column) -> Column:
                    group = F.floor(i / GROUP).cast("int")
                    start = F.get(before, group) + total(F.slice(step, group * GROUP + 1, i % GROUP)) + F.length(F.get(gaps, i))
                    return let(start, lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("match")))

                return F.transform(hits, span)

            prefix = let(groups, lambda g: F.transform(g, lambda _, i: total(F.slice(g, F.lit(1), i))))
            return let(prefix, spans)

        return let(steps, located)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps)))


EMPTY = "array<struct<start:int,end:int,match:string>>"


def _found(text: Column, layer: str, kind: str) -> Column:
    """Base matches that pass their check, or wide matches, of one kind."""
    pattern = (BASE if layer == "base" else WIDE)[kind]
    found = matches(text, pattern)
    if layer == "base" and kind != "email":
        found = F.filter(found, lambda s: passes(kind, s["match"]))
    return F.coalesce(F.when(HINT[layer, kind](text), found), F.array().cast(EMPTY))


def with_spans(rows: DataFrame, text: str) -> DataFrame:
    """Adds the base spans of each kind and the wide candidates that no base span overlaps."""
    rows = rows.withColumns({f"base_{k}": _found(F.col(text), "base", k) for k in KINDS})
    taken = F.concat(*[f"base_{k}" for k in KINDS])

    def clear(found: Column) -> Column:
        return F.filter(found, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return rows.withColumns({f"wide_{k}": clear(_found(F.col(text), "wide", k)) for k in KINDS})


def _signer(kind: str, base: bool, text: Column):
    return lambda span: _signature(kind, base, text, span)


def _namer(kind: str):
    return lambda span: F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def _chooser(sign, good: list[str]):
    return lambda span: let(sign(span), lambda x: F.concat(x["votes"], x["form"])).isin(good)


def _signature(kind: str, base: bool, text: Column, span: Column) -> Column:
    """Votes (1 for, 0 against, - abstains) of regex, gazetteer, context and check; and the span's form."""
    match = span["match"]
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - WINDOW + 1), F.least(F.lit(WINDOW), span["start"]))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(match, r"(?i) ?[(\[{]dot[)\]}] ?", "."), r"(?i) ?[(\[{]at[)\]}] ?", "@") if kind == "email" else match
    check = {
        "email": plain.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$"),
        "ip": F.lit(True),
        "card": F.lit(True) if base else passes("card", match),
        "phone": F.lit(True) if base else F.length(digits(match)).between(8, 15),
    }[kind]
    votes = F.concat(
        F.lit("1" if base else "0"),
        F.when(plain.rlike(GAZETTEER[kind]), "1").otherwise("0"),
        F.when(before.rlike(CONTEXT[kind]), "1").otherwise("-"),
        F.when(check, "1").otherwise("0"),
    )
    form = F.concat_ws(
        "",
        F.least(F.lit(9), F.floor(F.length(match) / 4)).cast("string"),
        F.when(match.rlike(r"[ ]"), "s").otherwise("n"),
        F.when(match.rlike(r"[().]"), "p").otherwise("n"),
        F.when(after.rlike(r"^[A-Za-z0-9]"), "w").otherwise("n"),
    )
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), votes.alias("votes"), form.alias("form"))


def signatures(rows: DataFrame, text: str) -> DataFrame:
    """``kind, base, votes, form, n``: how often each combination occurs over all candidates."""
    parts = [F.transform(f"{layer}_{k}", _signer(k, layer == "base", F.col(text))) for k in KINDS for layer in ("base", "wide")]
    seen = with_spans(rows, text).where(" OR ".join(f"size({layer}_{k}) > 0" for k in KINDS for layer in ("base", "wide")))
    each = seen.select(F.explode_outer(F.concat(*parts)).alias("s")).where("s IS NOT NULL")
    return each.groupBy("s.kind", "s.base", "s.votes", "s.form").agg(F.count("*").alias("n"))


def reliabilities(counts: dict[str, float], rounds: int = 50) -> dict[str, float]:
    """Expectation maximisation over vote patterns: the probability that a candidate with these votes is real."""
    size = len(next(iter(counts)))
    real = {v: (1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for v in counts}
    for _ in range(rounds):
        chances = {}
        for truth in (True, False):
            weight = {v: n * (real[v] if truth else 1 - real[v]) for v, n in counts.items()}
            total = sum(weight.values())
            chances[truth] = (total, [{c: (sum(w for v, w in weight.items() if v[j] == c) + 1) / (total + 3) for c in "10-"} for j in range(size)])
        for v in counts:
            a, b = (math.log(chances[t][0] + 1) + sum(math.log(chances[t][1][j][c]) for j, c in enumerate(v)) for t in (True, False))
            real[v] = 1 / (1 + math.exp(min(700, b - a)))
    return real


def train(combinations) -> dict[tuple[str, bool, str, str], float]:
    """Score of each combination: naive Bayes over votes and form, trained on the posteriors of the votes.

    ``combinations`` are rows of :func:`signatures`; their number is bounded by the votes and forms
    that exist (a few thousand), however many candidates there are.
    """
    scores = {}
    for kind in KINDS:
        own = [r for r in combinations if r["kind"] == kind]
        if not own:
            continue
        counts: dict[str, float] = {}
        for r in own:
            counts[r["votes"]] = counts.get(r["votes"], 0) + r["n"]
        real = reliabilities(counts)
        features = lambda r: list(enumerate(r["votes"] + r["form"]))
        sums: dict[tuple, list[float]] = {}
        total = [1.0, 1.0]
        for r in own:
            for truth, weight in enumerate((1 - real[r["votes"]], real[r["votes"]])):
                total[truth] += weight * r["n"]
                for f in features(r):
                    sums.setdefault(f, [0.0, 0.0])[truth] += weight * r["n"]
        for r in own:
            odds = math.log(total[1] / total[0])
            for f in features(r):
                odds += math.log((sums[f][1] + 1) / (total[1] + 3)) - math.log((sums[f][0] + 1) / (total[0] + 3))
            scores[kind, r["base"], r["votes"], r["form"]] = 1 / (1 + math.exp(min(700, -odds)))
    return scores


def find(documents: DataFrame, text: str = "text", least: float = 0.9) -> tuple[DataFrame, Column, Column]:
    """Rows with their spans: the frame, the base spans and all spans as arrays of (kind, start, end).

    ``documents`` may have any columns; those added are named ``base_*`` and ``wide_*``.
    """
    scores = train(signatures(documents.select(text), text).collect())
    rows = with_spans(documents, text)
    base, spans = [], []
    for k in KINDS:
        good = [v + f for (kind, own, v, f), score in scores.items() if kind == k and not own and score >= least]
        own = F.transform(f"base_{k}", _namer(k))
        base.append(own)
        if good:
            own = F.array_sort(F.concat(own, F.transform(F.filter(f"wide_{k}", _chooser(_signer(k, False, F.col(text)), good)), _namer(k))))
        spans.append(own)
    return rows, F.concat(*base), F.concat(*spans)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """Counts of base spans, the digest of their list and the list of all spans of every row."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, base, every = find(rows, "text", least)
    counts = [F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return rows.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def redact(documents: DataFrame, text: str = "text", size: str = "n_chars", least: float = 0.9) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; ``size`` is counted anew where a text changed."""
    own = documents.columns
    body, every = fresh(documents, "body"), fresh(documents, "every")
    rows = documents.withColumn(body, F.col(text))
    found, _, spans_ = find(rows.withColumnsRenamed({c: f"kept {c}" for c in own}), body, least)
    found = found.withColumn(every, F.array_sort(spans_, lambda a, b: a["start"] - b["start"]))

    def cut(list_: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            reached = F.coalesce(F.array_max(F.transform(F.slice(list_, F.lit(1), i), lambda x: x["end"])), F.lit(0))  # spans may overlap
            gap = let(reached, lambda at: F.substring(F.col(body), at + 1, F.greatest(F.lit(0), s["start"] - at)))
            return F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))

        rest = F.substring(F.col(body), F.array_max(F.transform(list_, lambda x: x["end"])) + 1, F.length(body))
        return F.concat(F.array_join(F.transform(list_, piece), ""), rest)

    changed = F.size(every) > 0
    found = found.withColumn(body, F.when(changed, cut(F.col(every))).otherwise(F.col(body)))
    renamed = {text: F.col(body)}
    if size in own:
        renamed[size] = F.when(changed, F.length(body)).otherwise(F.col(f"kept {size}")).cast(documents.schema[size].dataType)
    return found.select(*[renamed.get(c, F.col(f"kept {c}")).alias(c) for c in own])


@register("op9_pii")
def op9_pii(spark, folder):
    """Personal data in every document."""
    return spans(table(spark, folder, "documents"))
