"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document of smaller
key, or in the same one further left. Strings never cross documents.

1. Every string (window) has an anchor, the leftmost of its smallest hashes of ``GRAM`` bytes. Equal windows
   have equal anchors, so only runs of windows around one anchor need to meet; a run and its bytes are one row
   (anchor, digest of the bytes, place). Of equal runs all but the first are repeated as a
   whole. Tasks sort that out for what they read before the shuffle, so copies move once a task.
2. Rows are ranged by (anchor, digest). Anchors with a single digest are done. The first runs of anchors
   with several digests are open: some of their windows may be equal.
3. Open runs are cut from the texts and dealt by anchor into shards of about ``SHARD`` bytes. Each shard
   gets a suffix array: suffixes are classified, the leftmost-smaller substrings sorted and named, pairs
   of names named again until they differ or cover a window, and the other suffixes induced bucket by
   bucket. Common prefixes of neighbours, permuted to text order and counted up to ``LENGTH``, give the
   classes of equal windows.
4. Anchors with more than ``GROUP`` open runs are spread over several shards; the first windows of each then
   meet by a 128-bit digest, so no task holds a whole group.
5. Ranges are collected per document and cut out.

Cases: NULL texts count as empty; texts shorter than a window keep all bytes. NULL keys come last. Rows with
equal keys are ordered by a hash of their text; rows equal in key and text are one document
and get the same result. An empty table gives no rows; other columns are ignored. Texts of any length
go through in overlapping parts.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.base import register, ship, table, trim
from paperloom.session import write_through

LENGTH, GRAM, PLACE_BITS = 100, 24, 21
PART, ROWS, SHARD, GROUP = 1 << 19, 1 << 19, 2 << 20, 8192
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
OTHER = np.uint64(0xBF58476D1CE4E5B9)
LAST = (1 << 63) - 1


# --- suffix array -----------------------------------------------------------------------------


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last suffix is followed by the empty one."""
    size = len(text)
    steps = np.zeros(size, np.int8)
    steps[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    steps[-1] = -1
    # Equal neighbours take the type of the first different one to their right.
    places = np.where(steps != 0, np.arange(size), size)
    following = np.minimum.accumulate(places[::-1])[::-1]
    return steps[following] > 0


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys, equal for equal keys, and how many there are."""
    order = np.argsort(keys, kind="stable")
    placed = keys[order]
    new = np.concatenate(([0], placed[1:] != placed[:-1])).cumsum()
    names = np.empty(len(keys), np.int64)
    names[order] = new
    return names, int(new[-1]) + 1


def sort_leftmost(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Leftmost-smaller suffixes in order of at least their first ``depth`` symbols.

    Their substrings, each up to and with the beginning of the next, are named by rank, eight symbols at
    a time. The string of names is the smaller problem; it is solved by naming pairs of neighbours
    again, each round twice as far, until all names differ or reach over ``depth`` symbols.
    """
    count = len(places)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)
    sizes = np.concatenate((np.diff(places) + 1, [len(text) - places[-1]]))
    names, kinds = np.zeros(count, np.int64), 1
    for shift in range(0, int(sizes.max()), 8):
        at = np.minimum(places + shift, len(text))
        key = np.ascontiguousarray(words[at]).view(">u8").reshape(-1).astype(np.uint64)
        left = np.clip(sizes - shift, 0, 8)
        # Behind its end a substring is larger than one that goes on: equal symbols, smaller type. The last
        # one ends with the text, which is smaller than any symbol.
        left[-1] = 8
        key |= np.where(left < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (left * 8).astype(np.uint64), np.uint64(0))
        part, parts = _names(key)
        names, kinds = (part, parts) if shift == 0 else _names(names * parts + part)
    reach = 2  # a substring begins at least two symbols behind the one before
    step = 1
    while kinds < count and reach < depth:
        following = np.zeros(count, np.int64)
        following[:-step] = names[step:] + 1
        names, kinds = _names(names * (kinds + 1) + following)
        step, reach = 2 * step, 2 * reach
    return places[np.argsort(names, kind="stable")]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of a text of symbols 1 to 254 in order of at least their first ``depth`` symbols."""
    size = len(text)
    if size == 0:
        return np.zeros(0, np.int64)
    smaller = suffix_types(text)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    places = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    found = np.full(size, -1, np.int64)
    leftmost = sort_leftmost(text, places, depth) if len(places) else places
    by_symbol = text[leftmost]
    firsts = np.searchsorted(by_symbol, np.arange(257))
    heads = starts.copy()

    def put(suffixes: np.ndarray, symbol: int) -> None:
        """Larger suffixes that end in the given ones go to the front of their buckets, in order."""
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, number = before[order], np.bincount(symbols, minlength=256)
        offset = np.cumsum(number) - number
        found[np.repeat(heads - offset, number) + np.arange(len(before))] = before
        heads[:] += number

    put(np.array([size]), 0)  # the empty suffix is smaller than all
    for symbol in np.flatnonzero(counts).tolist():
        done = int(starts[symbol])
        while done < heads[symbol]:
            new, done = found[done : heads[symbol]].copy(), int(heads[symbol])
            put(new, symbol)
        own = leftmost[firsts[symbol] : firsts[symbol + 1]]
        if len(own):
            put(own, symbol)
    tails = ends.copy()

    def put_back(suffixes: np.ndarray) -> None:
        """Smaller suffixes that end in the given ones (largest first) go to the back of their buckets."""
        before = suffixes[suffixes > 0] - 1
        before = before[smaller[before]]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, number = before[order], np.bincount(symbols, minlength=256)
        offset = np.cumsum(number) - number
        found[np.repeat(tails - 1 + offset, number) - np.arange(len(before))] = before
        tails[:] -= number

    for symbol in np.flatnonzero(counts)[::-1].tolist():
        done = int(ends[symbol])
        while done > tails[symbol]:
            new, done = found[int(tails[symbol]) : done][::-1].copy(), int(tails[symbol])
            put_back(new)
        put_back(found[int(starts[symbol]) : int(heads[symbol])][::-1].copy())
    return found


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """By text position: the common prefix of a suffix with the one before it in ``order``, up to ``limit``."""
    padded = np.concatenate((text, np.zeros(limit + 8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    shared = np.zeros(len(text), np.int64)
    open_, before = order[1:], order[:-1]
    for shift in range(0, limit, 8):
        if not len(open_):
            break
        a = np.ascontiguousarray(words[open_ + shift]).view("<u8").reshape(-1)
        b = np.ascontiguousarray(words[before + shift]).view("<u8").reshape(-1)
        apart = a ^ b
        same = apart == 0
        low = apart & (~apart + np.uint64(1))
        equal = np.where(same, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        shared[open_] = np.minimum(limit, shift + equal)
        open_, before = open_[same], before[same]
    return shared


def equal_windows(runs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all runs: run, offset and class; equal windows have equal classes."""
    sizes = np.array([len(r) for r in runs])
    text = np.frombuffer(b"\xff".join(runs) + b"\xff", np.uint8) + np.uint8(2)  # 255, in no UTF-8 text, becomes 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = np.maximum(0, sizes - length + 1)
    run = np.repeat(np.arange(len(runs)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.zeros(len(text), bool)
    window[begins[run] + offset] = True
    order = suffix_array(text, length)
    order = order[window[order]]
    shared = common_prefixes(text, order, length)
    classes = np.zeros(len(text), np.int64)
    classes[order] = (shared[order] < length).cumsum()
    return run, offset, classes[begins[run] + offset]


# --- anchors ----------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _powers(size: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)])))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, found = 1, values
    while size * 2 <= width:
        found, size = np.minimum(found[:-size], found[size:]), size * 2
    rest = width - size
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def anchored_runs(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: part, first window, number of windows, anchor, digest of the bytes.

    The digest holds the number of windows in its low seven bits.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    codes = np.frombuffer(b"".join(parts), np.uint8)
    if len(codes) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    up, down = _powers(1 << int(len(codes)).bit_length())
    sums = _sums(codes, up)
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(codes) - GRAM + 1] * MIX
    grams = (grams ^ (grams >> np.uint64(32))) * BASE
    # The high bits of a hash and its place: the smallest is the leftmost of equal ones.
    mask = np.uint64((1 << PLACE_BITS) - 1)
    lowest = _sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1) & mask
    counts = np.maximum(0, sizes - LENGTH + 1)
    part = np.repeat(np.arange(len(parts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first + (ends - sizes)[part]
    anchors = lowest[at]
    if not len(anchors):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (part[1:] != part[:-1])))
    begin = np.flatnonzero(new)
    number = np.diff(np.concatenate((begin, [len(anchors)])))
    low = at[begin]
    digest = (sums[low + number - 1 + LENGTH] - sums[low]) * down[low] * OTHER
    digest = ((digest ^ (digest >> np.uint64(29))) * MIX) & np.uint64(0xFFFFFFFFFFFFFF80) | number.astype(np.uint64)
    return part[begin], first[begin], number, grams[anchors[begin]].view(np.int64), digest.view(np.int64)


ROW = "h long, c long, id long, at long"


def _batch(names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _local(h, c, id_, at):
    """Sorts out what one task has read: first runs as they are, repeated ones marked by c = number of windows.

    Marked rows get an anchor of their own, so that they spread.
    """
    order = np.lexsort((at, id_, c, h))
    h, c, id_, at = h[order], c[order], id_[order], at[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = ~new & ((id_ != id_[first]) | (at != at[first]))
    same = ~new & ~again
    spread = (id_.astype(np.uint64) * BASE ^ at.astype(np.uint64) * MIX).view(np.int64)
    h, c = np.where(again, spread, h), np.where(again, c & 127, c)
    keep = ~same
    return h[keep], c[keep], id_[keep], at[keep]


def _anchor_rows(batches):
    """Rows of all runs of (id, tie, text) batches."""
    held, count = [], 0
    group, size = [], 0

    def cut():
        nonlocal group, size, count
        part, first, number, h, c = anchored_runs([raw for _, _, _, raw in group])
        ids = np.array([g[0] for g in group], np.int64)[part]
        ties = np.array([g[1] for g in group], np.int64)[part]
        shifts = np.array([g[2] for g in group], np.int64)[part]
        held.append((h, c, ids, (ties << 32) | (first + shifts)))
        count += len(h)
        group, size = [], 0

    def flush():
        nonlocal held, count
        columns = _local(*(np.concatenate(x) for x in zip(*held)))
        held, count = [], 0
        for at in range(0, len(columns[0]), 1 << 16):
            yield _batch(["h", "c", "id", "at"], [x[at : at + (1 << 16)] for x in columns])
        del columns
        trim()

    for batch in batches:
        for id_, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
            raw = text.as_py().encode("utf-8", "replace")
            for shift in range(0, max(0, len(raw) - LENGTH + 1), PART):
                group.append((id_, tie, shift, raw[shift : shift + PART + LENGTH - 1]))
                size += len(group[-1][3])
                if size >= PART:
                    cut()
            if count >= ROWS:
                yield from flush()
    if group:
        cut()
    if count:
        yield from flush()


def _sorted_out(batches):
    """From rows in order of (h, c, id, at): repeated runs (kind 0) and open runs (kind 1).

    Whether the first and last anchor go on in another partition is unknown, so their runs count as open.
    """
    last = None  # h, c, id, at of the first run of the newest digest
    held = None  # its row, and whether it is open

    def rows(kind, h, id_, at, n):
        return _batch(["kind", "h", "id", "at", "n"], [np.full(len(h), kind, np.int32), h, id_, at, n.astype(np.int32)])

    for batch in batches:
        h, c, id_, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "id", "at"))
        marked = (c >= 0) & (c < 128)
        if marked.any():
            yield rows(0, h[marked], id_[marked], at[marked], c[marked])
            h, c, id_, at = h[~marked], c[~marked], id_[~marked], at[~marked]
        if not len(h):
            continue
        front = last or (None,) * 4
        new = np.concatenate(([(h[0], c[0]) != front[:2]], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        place = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first_id = np.where(place >= 0, id_[place], front[2] if last else 0)
        first_at = np.where(place >= 0, at[place], front[3] if last else 0)
        again = ~new & ((id_ != first_id) | (at != first_at))
        if again.any():
            yield rows(0, h[again], id_[again], at[again], c[again] & 127)
        newest = int(place[-1])
        if newest >= 0:
            last = (h[newest], c[newest], id_[newest], at[newest])
        h, c, id_, at = (x[new] for x in (h, c, id_, at))
        if held is not None:
            h, c, id_, at = (np.concatenate(([v], x)) for v, x in zip(held[0], (h, c, id_, at)))
        if not len(h):
            continue
        beside = np.concatenate(([True if held is None else held[1]], h[1:] == h[:-1]))
        open_ = beside | np.concatenate((h[1:] == h[:-1], [False]))
        held = ((h[-1], c[-1], id_[-1], at[-1]), bool(beside[-1]))
        open_[-1] = False
        if open_.any():
            yield rows(1, h[open_], id_[open_], at[open_], c[open_] & 127)
    if held is not None:
        h, c, id_, at = (np.array([v]) for v in held[0])
        yield rows(1, h, id_, at, c & 127)


def _cut_runs(batches):
    """The bytes of open runs of (id, tie, text, runs) batches."""
    for batch in batches:
        h, spread, ids, ats, parts = [], [], [], [], []
        for id_, text, runs in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("runs")):
            raw = text.as_py().encode("utf-8", "replace")
            for run in runs.as_py():
                low = run["at"] & 0xFFFFFFFF
                h.append(run["h"])
                spread.append(run["part"])
                ids.append(id_)
                ats.append(run["at"])
                parts.append(raw[low : low + run["n"] - 1 + LENGTH])
        for at in range(0, len(h), 1 << 14):
            stop = at + (1 << 14)
            yield _batch(["h", "part", "id", "at", "run"], [np.array(h[at:stop], np.int64), np.array(spread[at:stop], np.int32), np.array(ids[at:stop], np.int64), np.array(ats[at:stop], np.int64), pa.array(parts[at:stop], pa.binary())])


FOUND = "kind int, id long, at long, n int, w1 long, w2 long"


def _shard(split, ids, ats, runs):
    """Repeated windows of one shard as ranges (kind 0); first windows of anchors that are spread (kind 2)."""
    run, offset, cls = equal_windows(runs)
    documents, doc = np.unique(np.stack((ids, ats >> 32), axis=1), axis=0, return_inverse=True)
    start = (ats & 0xFFFFFFFF)[run] + offset
    place = (doc.reshape(-1).astype(np.int64)[run] << 33) | start
    best = np.full(int(cls.max(initial=0)) + 1, LAST)
    np.minimum.at(best, cls, place)
    gone = place > best[cls]
    out = []
    if gone.any():
        edge_run = run[gone]
        # A range ends where windows stay, or with its run.
        at = np.flatnonzero(gone)
        new = np.concatenate(([True], (np.diff(at) > 1) | (edge_run[1:] != edge_run[:-1])))
        begin = at[new]
        length = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
        out.append((np.zeros(len(begin), np.int32), ids[run[begin]], ats[run[begin]] + offset[begin], length.astype(np.int32), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)))
    if split.any():
        text = np.frombuffer(b"".join(runs), np.uint8)
        begins = np.cumsum([len(r) for r in runs]) - np.array([len(r) for r in runs])
        size = 1 << int(len(text)).bit_length()
        (up, down), (up2, down2) = _powers(size), _powers(size, int(OTHER))
        sums, sums2 = _sums(text, up), _sums(text ^ np.uint8(0x55), up2)
        stay = np.flatnonzero(~gone & split[run])
        low = begins[run[stay]] + offset[stay]
        w1 = ((sums[low + LENGTH] - sums[low]) * down[low]).view(np.int64)
        w2 = ((sums2[low + LENGTH] - sums2[low]) * down2[low]).view(np.int64)
        out.append((np.full(len(stay), 2, np.int32), ids[run[stay]], ats[run[stay]] + offset[stay], np.ones(len(stay), np.int32), w1, w2))
    for columns in out:
        for at in range(0, len(columns[0]), 1 << 16):
            yield _batch(["kind", "id", "at", "n", "w1", "w2"], [x[at : at + (1 << 16)] for x in columns])


def _shards(batches):
    """Rows in order of (h, part), taken in shards of whole groups of about SHARD bytes."""
    held, size = [], 0

    def flush():
        nonlocal held, size
        split, ids, ats = (np.concatenate([x[i] for x in held]) for i in range(1, 4))
        yield from _shard(split >= 0, ids, ats, [r for x in held for r in x[4]])
        held, size = [], 0
        trim()

    for batch in batches:
        h, part, ids, ats = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "part", "id", "at"))
        runs = batch.column("run").to_pylist()
        new = np.concatenate(([not held or (held[-1][0], held[-1][1][-1]) != (h[0], part[0])], (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
        begin = np.flatnonzero(new).tolist()
        for at, stop in zip([0, *begin] if not begin or begin[0] else begin, [*(begin if not begin or begin[0] else begin[1:]), len(runs)]):
            if size >= SHARD and new[at]:
                yield from flush()
            if stop > at:
                held.append((h[at], part[at:stop], ids[at:stop], ats[at:stop], runs[at:stop]))
                size += sum(map(len, runs[at:stop])) + stop - at
    if held:
        yield from flush()


def _kept(batches):
    """Per document: bytes, removed bytes and runs, digest of the rest, from (key, text, ranges)."""
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            raw = text.as_py().encode("utf-8", "replace")
            gone = []
            for low, high in sorted((r["at"] & 0xFFFFFFFF, (r["at"] & 0xFFFFFFFF) + r["n"] - 1 + LENGTH) for r in ranges.as_py() or ()):
                if gone and low <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], high)
                else:
                    gone.append([low, high])
            digest, reached = hashlib.sha256(), 0
            for low, high in gone:
                digest.update(raw[reached:low])
                reached = high
            digest.update(raw[reached:])
            rows.append((len(raw), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``id, at, n`` of repeated windows of (id, tie, text): ``n`` windows from ``at`` (tie and offset)."""
    ship(texts.sparkSession)
    anchors = texts.mapInArrow(_anchor_rows, ROW)
    ordered = anchors.repartitionByRange("h", "c").sortWithinPartitions("h", "c", "id", "at")
    runs = write_through(ordered.mapInArrow(_sorted_out, "kind int, h long, id long, at long, n int"), "runs")

    open_ = runs.where("kind = 1").select("h", "id", "at", "n")
    large = open_.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > GROUP)
    part = F.when(F.col("size").isNull(), -1).otherwise(F.pmod(F.xxhash64("id", "at"), F.ceil(F.col("size") / GROUP))).cast("int")
    wanted = open_.join(large, "h", "left").select("id", F.shiftright("at", 32).alias("tie"), F.struct("h", part.alias("part"), "at", "n").alias("run"))
    wanted = wanted.groupBy("id", "tie").agg(F.collect_list("run").alias("runs"))
    cut = texts.join(wanted, ["id", "tie"]).select("id", "text", "runs").mapInArrow(_cut_runs, "h long, part int, id long, at long, run binary")
    shards = cut.repartition("h", "part").sortWithinPartitions("h", "part", "id", "at")
    found = write_through(shards.mapInArrow(_shards, FOUND), "windows")

    place = F.struct("id", "at")
    meet = found.where("kind = 2").withColumn("first", F.min(place).over(Window.partitionBy("w1", "w2")))
    spread = meet.where(place > F.col("first"))
    return runs.where("kind = 0").select("id", "at", "n").unionAll(found.where("kind = 0").select("id", "at", "n")).unionAll(spread.select("id", "at", "n"))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_bytes, n_removed, n_spans, kept_sha256`` and the removed spans (bytes)."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("id"), body.alias("text"))
    texts = texts.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 33))
    ranges = repeated_ranges(texts.select("id", "tie", "text"))
    ranges = ranges.groupBy("id", F.shiftright("at", 32).alias("tie")).agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    kind = documents.schema[key].dataType.simpleString()
    found = texts.join(ranges, ["id", "tie"], "left").select("key", "text", "ranges")
    found = found.mapInArrow(_kept, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>")
    return found.withColumnRenamed("key", key)


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, folder):
    """Every document without the bytes of strings that occur before."""
    return remove_repeats(table(spark, folder, "documents"))
