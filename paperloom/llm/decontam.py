"""Benchmark decontamination: CGK embedding, bit sampling and edit verification over words.

Texts and benchmark items are sequences of lower-cased words (runs of letters, marks and digits by Unicode
category; every letter is one word in scripts that put no spaces between words), so punctuation,
spaces of any kind and layout do not count. A CGK random walk copies a sequence symbol by symbol: after each
output a random bit of (step, symbol) decides whether to go on, so after an edit two walks meet
again and edit distance becomes Hamming distance. Sampling a few places of the
embedding gives a hash key. Keys are taken of the windows at every word of every text and, for the items,
from every word on; one common key anywhere along an item proposes the item-sized window that
lies around it. ``WALKS`` embeddings with two samples each are repeated. A proposal is verified by the exact edit
distance between the item and the best window (words; insertions, deletions and
substitutions), which must be at most ``share`` of the item's words.

A walk reads at most as many words as it has taken steps, about half as many on average: near samples
(10 steps) see some five words, far ones (18 steps, half of them sampled) some nine of which a few may
differ. As every word of an item begins a window, an item is missed only if no stretch of about five
words between edits survives; the tests measure the recall up to the largest share of edits.

Different item texts are compared in blocks of at most about ``block`` texts and ``BYTES`` bytes, whose index is
sent to the tasks, one block at a time; the number of passes grows with the benchmark, the index does not. The
ids of equal items are joined to the matches by Spark. Texts are never shuffled, and texts of any length go through
in parts of bounded size. Parts overlap by words, twice the longest window, so that every window lies
whole in one part however wide the gaps between its words are.

Cases: NULL or empty texts contain nothing. Items of fewer than five words name no passage and match
nothing; items of fewer than ten words must match without edits. Equal items are found
each under its id, NULL ids included. Repeated rows are each judged; empty tables give no matches;
other columns are ignored (or kept by ``drop_contaminated``).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, fresh, register, table
from paperloom.operators.numbering import small
from paperloom.session import write_through

SHARE, BLOCK = 0.2, 5000
WALKS, NEAR, FAR, LEAST = 3, 10, 18, 5
PART, BYTES, LINE = 1 << 19, 1 << 24, 1 << 20
BASE = 0x9E3779B97F4A7C15
TOP = (1 << 64) - 1
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS = [_powers(1)]


def _word_bytes() -> np.ndarray:
    found = np.zeros(256, bool)
    found[[*range(48, 58), *range(97, 123)]] = True
    found[128:] = True
    return found


WORD = _word_bytes()


#: Scripts without spaces between words: Thai to Myanmar, Khmer, Tai, Balinese, Japanese, Bopomofo, Han, Javanese.
UNSPACED = [
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]
APART, INSIDE, SINGLE, MARK = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: whether it separates words, is in one, is one or goes on with what is before it."""
    found = np.array([{"L": INSIDE, "N": INSIDE, "M": MARK}.get(unicodedata.category(chr(c))[0], APART) for c in range(0x110000)], np.uint8)
    for low, high in UNSPACED:
        part = found[low : high + 1]
        part[[p == INSIDE and unicodedata.category(chr(low + at)) != "Nd" for at, p in enumerate(part)]] = SINGLE
    return found


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words."""
    inside = WORD[codes]
    begins = np.zeros(len(codes), bool)
    if (codes >= 128).any():
        lead = np.flatnonzero(codes >= 0xC0)
        more = np.concatenate((codes, np.zeros(3, np.uint8))).astype(np.int64)
        first = more[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for step in (1, 2, 3):
            point = np.where(step < size, (point << 6) | (more[lead + step] & 0x3F), point)
        kind = _kinds()[np.minimum(point, 0x10FFFF)]
        kinds = inside.astype(np.uint8)
        kinds[codes >= 128] = APART
        kinds[lead] = kind
        for step in (1, 2, 3):  # a text may be cut within its last code point
            goes_on = (step < size) & (more[lead + step] >> 6 == 2)
            kinds[lead[goes_on] + step] = kind[goes_on]
        inside = kinds != APART
        begins[lead] = kind == SINGLE
        begins[1:] |= (kinds[1:] == INSIDE) & (kinds[:-1] == SINGLE)
    before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
    begins = np.concatenate((begins, [False]))
    return np.flatnonzero(after & (~before | begins)), np.flatnonzero(before & (~after | begins))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the words of lower-cased UTF-8, and their byte ranges."""
    codes = np.frombuffer(raw, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(_POWERS[0][0]) < len(codes) + 1:
        _POWERS[0] = _powers(len(codes) + 1)
    up, down = _POWERS[0]
    starts, ends = _bounds(codes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
    hashes = (sums[ends] - sums[starts]) * down[starts] * MIX
    return (hashes >> np.uint64(32)).astype(np.uint32), starts, ends


class Walks:
    """The random bits and sampled steps of all embeddings, the same in every task."""

    def __init__(self):
        draw = np.random.default_rng(20)
        self.odd = draw.integers(0, 1 << 31, (WALKS, FAR), np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        # A walk rests on a word for two steps on average, so samples of fewer steps would see two or three words.
        self.samples = [(np.sort(draw.choice(NEAR, 8, False)), np.sort(draw.choice(FAR, 9, False))) for _ in range(WALKS)]
        # Short items have one sample within their first words.
        self.short = np.arange(LEAST)

    def keys(self, symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys of the windows at all places: near and far per walk, then the short one; and the words each has read.

        ``symbols`` must go on for FAR symbols behind the last place.
        """
        places = np.arange(len(symbols) - FAR)
        found, read = [], []
        for walk in range(WALKS):
            near, far = self.samples[walk]
            at = places.astype(np.int32)
            keys = [np.full(len(places), np.uint64(2 * walk + 1)), np.full(len(places), np.uint64(2 * walk + 2))]
            for step in range(int(far[-1]) + 1):
                symbol = symbols[at]
                for sample, key in ((near, keys[0]), (far, keys[1])):
                    if step in sample:
                        np.multiply(key, np.uint64(BASE), out=key)
                        np.add(key, symbol, out=key)
                    if step == sample[-1]:
                        read.append(at - places + 1)
                at += ((symbol * self.odd[walk, step]) >> np.uint32(31)).astype(np.int32)
            found += keys
        key = np.full(len(places), np.uint64(0))
        for step in self.short:
            key = key * np.uint64(BASE) + symbols[places + step]
        found.append(key)
        read.append(np.full(len(places), LEAST))
        return [k * MIX for k in found], read


class Index:
    """Items of one block with the keys of their windows."""

    def __init__(self, items: list[str | None]):
        self.items = [words((t or "").lower().encode("utf-8", "replace"))[0] for t in items]
        self.limits = [int(SHARE * len(w)) if len(w) >= 2 * LEAST else 0 for w in self.items]
        self.lists = [item.tolist() for item in self.items]
        self.longest = max(map(len, self.items), default=0)
        self.walks = walks = Walks()
        rows: list[tuple[list, list]] = [([], []) for _ in range(2 * WALKS + 1)]
        for number, item in enumerate(self.items):
            size = len(item)
            if size < LEAST:
                continue
            padded = np.concatenate((item, np.zeros(FAR, np.uint32)))
            offsets = np.arange(size)
            for slot, (key, read) in enumerate(zip(*walks.keys(padded))):
                room = LEAST if slot == 2 * WALKS else (NEAR, FAR)[slot % 2]
                if slot == 2 * WALKS and size >= FAR:
                    continue
                keep = offsets[: max(0, size - room + 1)]  # a walk never leaves the item
                keep = keep[read[keep] >= LEAST - 1]  # nor rests on words that are everywhere
                rows[slot][0].append(key[keep])
                rows[slot][1].append(np.stack((np.full(len(keep), number), keep), axis=1))
        self.slots = []
        for keys, owners in rows:
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            owners = np.concatenate(owners) if owners else np.zeros((0, 2), np.int64)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[keys >> np.uint64(44)] = True
            self.slots.append((keys[order], owners[order], maybe))

    def proposals(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, item, first word) of proposed windows; ``bounds`` are the texts' first words and the end."""
        found = []
        padded = np.concatenate((symbols, np.zeros(FAR, np.uint32)))
        for (keys, owners, maybe), own in zip(self.slots, self.walks.keys(padded)[0]):
            places = np.flatnonzero(maybe[own >> np.uint64(44)])
            if not len(places) or not len(keys):
                continue
            low, high = np.searchsorted(keys, own[places], "left"), np.searchsorted(keys, own[places], "right")
            count = high - low
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places = np.repeat(places, count)
            texts = np.searchsorted(bounds, places, "right") - 1
            found.append(np.stack((texts, owners[at, 0], places - owners[at, 1]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def search(self, symbols: np.ndarray, bounds: np.ndarray, goes_on: list[tuple[bool, bool]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end) of verified windows, the best of those that overlap.

        ``goes_on`` tells for each text whether it is a part with others before and behind it; windows that
        reach beyond it are left to these.
        """
        found: list[tuple[int, int, int, int, int]] = []
        for text, number, first in self.proposals(symbols, bounds).tolist():
            item, limit = self.items[number], self.limits[number]
            before, behind = goes_on[text]
            if (before and first - limit < bounds[text]) or (behind and first + len(item) + limit > bounds[text + 1]):
                continue
            last = found[-1] if found and found[-1][:2] == (text, number) else None
            if last and first < last[4] and last[2] == 0:
                continue
            low, high = max(int(bounds[text]), first - limit), min(int(bounds[text + 1]), first + len(item) + limit)
            region = symbols[low:high]
            if sum(map(set(region.tolist()).__contains__, self.lists[number])) < len(item) - limit:
                continue  # too many words are missing, whatever the order
            edits, start, end = best_window(item, region)
            if edits > limit:
                continue
            match = (text, number, edits, low + start, low + end)
            if last and match[3] < last[4]:
                if edits < last[2]:
                    found[-1] = match
                continue
            found.append(match)
        return found


def best_window(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance between the item and a window of the region: edits, start and end."""
    size = len(region)
    cost, origin = np.zeros(size + 1, np.int64), np.arange(size + 1)
    steps = np.arange(size + 1)
    for row, symbol in enumerate(item, 1):
        swap, drop = cost[:-1] + (region != symbol), cost[1:] + 1
        take = swap <= drop
        new = np.concatenate(([row], np.where(take, swap, drop)))
        source = np.concatenate(([0], np.where(take, origin[:-1], origin[1:])))
        # Insertions from the left: running minimum of cost minus position.
        slack = new - steps
        low = np.minimum.accumulate(slack)
        place = np.maximum.accumulate(np.where(slack == low, steps, 0))
        cost, origin = low + steps, source[place]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def parts_of(raw: bytes):
    """(offset, bytes) of consecutive parts of about ``PART`` bytes that end between words.

    Where nothing separates words for ``LINE`` bytes, a part ends between code points.
    """
    at = 0
    while at < len(raw):
        end = at + PART
        while end < min(len(raw), at + PART + LINE) and WORD[raw[end]]:
            end += 1
        while end < len(raw) and raw[end] >> 6 == 2:
            end += 1
        yield at, raw[at:end]
        at = end


def scan(texts, index: Index) -> list[list[tuple[int, int, int, int]]]:
    """For every text its (item, edits, start, end); offsets in bytes of the lower-cased text.

    Texts are searched together in groups of about ``PART`` bytes, longer ones in parts that begin with the last
    words of the part before.
    """
    again = 2 * (index.longest + 2 * max(index.limits, default=0)) + FAR
    results: list[list] = []
    group: list[tuple] = []  # number of the text, symbols, starts, ends, goes on before, behind
    size = 0

    def flush() -> None:
        nonlocal group, size
        bounds = np.cumsum([0] + [len(part[1]) for part in group])
        symbols = np.concatenate([part[1] for part in group])
        for at, item, edits, first, last in index.search(symbols, bounds, [part[4:] for part in group]) if len(symbols) else ():
            number, _, starts, ends = group[at][:4]
            first, last = first - int(bounds[at]), last - int(bounds[at])
            results[number].append((item, int(starts[first]), edits, int(ends[max(first, last - 1)])))
        group, size = [], 0

    for number, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "replace")
        results.append([])
        held = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for shift, part in parts_of(raw):
            symbols, starts, ends = words(part)
            held = tuple(np.concatenate((old[-again:], new)) for old, new in zip(held, (symbols, starts + shift, ends + shift)))
            group.append((number, *held, shift > 0, shift + len(part) < len(raw)))
            size += len(part)
            if size >= PART:
                flush()
    if group:
        flush()
    return [_best(sorted(set(found))) for found in results]


def _best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) in order, the fewest edits of those of an item that overlap."""
    kept: list[tuple[int, int, int, int]] = []
    for item, start, edits, end in found:
        if kept and kept[-1][0] == item and start < kept[-1][3]:
            if edits < kept[-1][1]:
                kept[-1] = (item, edits, start, end)
            continue
        kept.append((item, edits, start, end))
    return kept


MATCHES = "array<struct<item int, edits int, start long, end long>>"


def matcher(index: Index, spark):
    """Column function: all matches of a text with the items of one block; and the broadcast, to be given up after use."""
    shared = spark.sparkContext.broadcast(index)

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = [[dict(zip(("item", "edits", "start", "end"), m)) for m in found] for found in scan((t.as_py() for t in texts), shared.value)]
        return pa.array(rows, kind)

    return arrow(run, MATCHES), shared


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def blocks(items: DataFrame, text: str, block: int, most: int = BYTES):
    """The different texts of the items in blocks of at most about ``block`` texts and ``most`` bytes.

    Yields their digests, their index and whether there are more blocks than one.
    """
    different = items.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("digest", digest(F.col("text")))
    row = different.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-row["n"] // block), -(-(row["bytes"] or 0) // most))
    placed = different.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    if parts > 1:
        placed = write_through(placed, "items")
    for part in range(parts):
        rows = placed.where(F.col("part") == part).orderBy("digest").collect()
        yield [r["digest"] for r in rows], Index([r["text"] for r in rows]), parts > 1


def contamination(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``key, item, edits, start, end``: every passage of a document that is within the limit of an item."""
    spark, found = documents.sparkSession, None
    for digests, index, several in blocks(items, item_text, block):
        run, shared = matcher(index, spark)
        rows = documents.select(F.col(key), run(F.col(text)).alias("found"))
        rows = rows.select(key, F.explode_outer("found").alias("m")).where("m IS NOT NULL")
        listed = spark.createDataFrame(list(enumerate(digests)), "item int, digest string")
        rows = rows.join(F.broadcast(listed), F.col("m.item") == F.col("item")).select(key, "digest", "m.edits", "m.start", "m.end")
        if several:  # one index at a time
            rows = write_through(rows, "matches")
            shared.destroy()
        found = rows if found is None else found.unionAll(rows)
    ids = small(items.select(digest(F.col(item_text)).alias("digest"), F.col(item).alias(fresh(documents, "item"))))
    name = fresh(documents, "item")
    return found.join(ids, "digest").select(key, F.col(name).alias(item), "edits", "start", "end")


def drop_contaminated(documents: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``documents`` that hold no passage of an item; columns stay as they are."""
    own, name = documents.columns, fresh(documents, "found")
    for _, index, several in blocks(items, item_text, block):
        run, shared = matcher(index, documents.sparkSession)
        documents = documents.withColumn(name, run(F.col(text))).where(F.size(name) == 0).select(*own)
        if several:
            documents = write_through(documents, "clean")
            shared.destroy()
    return documents


@register("op1_decontaminate")
def op1_decontaminate(spark, folder):
    """All passages of benchmark items in the documents."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
