"""Ids of repeated units of text: a bounded table per worker, searched for a whole group of texts at once."""

from __future__ import annotations

import functools

import numpy as np

STEP, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
SLOT_BITS, KEPT, KEPT_IDS = 20, 500_000, 4_000_000


def characters(*ranges: tuple[int, int]) -> np.ndarray:
    """Characters below 256 in some of the ranges; the last place stands for all others."""
    found = np.zeros(257, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: Latin letters.
LETTER = characters((65, 90), (97, 122), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, STEP, np.uint64), np.full(size, pow(STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Table:
    """Ids of units, found by a 64-bit hash of their characters and held against these, as arrays with open addressing."""

    def __init__(self):
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.first = np.zeros(1 << SLOT_BITS, np.int32)
        self.count = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << SLOT_BITS, np.int64)
        self.length = np.zeros(1 << SLOT_BITS, np.int64)
        self.codes = np.zeros(1 << 20, np.uint32)
        self.used = self.size = self.held = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where a key is missing."""
        found = np.full(len(keys), -1, np.int64)
        slot, open_ = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            found[open_[hit]] = slot[hit]
            on = ~hit & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return found

    def full(self) -> bool:
        return self.size > KEPT or self.used > KEPT_IDS or self.held > 4 * KEPT_IDS

    def add(self, keys: np.ndarray, parts: list[np.ndarray], codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """New, different keys with their ids; a unit's characters are ``lengths`` of ``codes`` from ``begins``."""
        chars = codes[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        if self.held + len(chars) > len(self.codes):
            self.codes = np.concatenate((self.codes, np.zeros(max(len(self.codes), len(chars)), np.uint32)))
        self.codes[self.held : self.held + len(chars)] = chars
        places = self.held + np.cumsum(lengths) - lengths
        self.held += len(chars)
        counts = np.fromiter(map(len, parts), np.int32, len(parts))
        ids = np.concatenate(parts)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        firsts = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.size += len(keys)
        slot, open_ = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.first[slot[put]], self.count[slot[put]] = keys[open_[put]], firsts[open_[put]], counts[open_[put]]
            self.begin[slot[put]], self.length[slot[put]] = places[open_[put]], lengths[open_[put]]
            on = np.ones(len(open_), bool)
            on[put] = False
            open_, slot = open_[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)

    def encode(self, joined: str, codes: np.ndarray, begins: np.ndarray, texts: np.ndarray, build) -> list[bytes]:
        """Ids of each text of ``joined`` as bytes.

        Units begin at ``begins``, texts at the units ``texts``; ``build`` gives the ids of new units.
        """
        stops = np.append(begins[1:], len(codes))
        up, down = _powers(1 << int(len(codes)).bit_length())
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
        keys = (sums[stops] - sums[begins]) * down[begins] * MIX
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(STEP) | np.uint64(1)
        lengths = stops - begins
        slots = self.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, place = np.unique(keys[missing], return_index=True)
            chosen = missing[place]
            units = [joined[a:b] for a, b in zip(begins[chosen].tolist(), stops[chosen].tolist())]
            self.add(new, build(units), codes, begins[chosen], lengths[chosen])
            slots[missing] = self.find(keys[missing])
        first, counts, ids = self.first[slots].astype(np.int64), self.count[slots].astype(np.int64), self.ids
        # Units of one hash but other characters get ids of their own.
        place = np.minimum(np.repeat(self.begin[slots] - begins, lengths) + np.arange(len(codes)), self.held - 1)
        differs = (self.length[slots] != lengths) | np.logical_or.reduceat(self.codes[place] != codes, begins)
        other = np.flatnonzero(differs)
        if len(other):
            parts = build([joined[a:b] for a, b in zip(begins[other].tolist(), stops[other].tolist())])
            counts[other] = list(map(len, parts))
            first[other] = self.used + np.cumsum(counts[other]) - counts[other]
            ids = np.concatenate([ids[: self.used], *parts])
        reach = np.cumsum(counts)
        found = ids[np.repeat(first - (reach - counts), counts) + np.arange(reach[-1])]
        cuts = np.append(np.concatenate(([0], reach))[texts], reach[-1]).tolist()
        return [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
