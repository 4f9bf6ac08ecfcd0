"""SentencePiece encoding and decoding by streaming Viterbi.

A text is cut into the pieces with the largest sum of log probabilities. The search keeps a
window: it goes on character by character, and once all paths that can still be continued (those
ending within one piece length of the front) run through a common boundary, the ids up to there
are committed and forgotten. So memory is bounded by how far paths stay apart, not by the text.

Where a vocabulary has no piece with the space mark behind another character, every first mark of a
run is such a boundary for all paths, and so are places between neighbours that no piece has. The
segments between repeat, so they are kept in a bounded table per worker (found by a hash and compared, see
``units``), and new short ones are searched many at a time by the same recurrence. Vocabularies without
that property are streamed whole.

A unigram model's scores are log probabilities. A merge vocabulary stores minus the rank of
each piece; Zipf's law makes that a probability: 1 / ((rank + 2.7) ln V). The ids are the
best path under these scores, not those of a merge encoder. Characters outside the vocabulary become
byte pieces (or the unknown id where the model has none; only then decoding loses them).
Decoding gives back every text exactly: a literal space mark is encoded as bytes.

Cases: NULL is encoded as the empty text, which has no ids. Repeated rows are each encoded; an empty
table gives no rows; other columns are ignored (or kept by ``with_ids``). Very long texts, also
without spaces, go through the same window.
"""

from __future__ import annotations

import functools
import importlib.util
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, register, table
from paperloom.llm.units import LETTER, Table, characters

MARK = "▁"
SWAP = str.maketrans({" ": MARK, MARK: " "})
MODEL = "piece_bpe_32k.model"
LONGEST, TOGETHER = 64, 24
BASE, MIX, TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), (1 << 64) - 1


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file: the installed package, or its usual folder."""
    found = importlib.util.find_spec("public_tokenizers")
    if found is not None:
        return importlib.import_module("public_tokenizers").path(name)
    return f"/opt/tokenizers/{name}"


def marked(text: str) -> str:
    """The text with space and space mark exchanged, behind the leading mark."""
    return MARK + (text.translate(SWAP) if MARK in text else text.replace(" ", MARK))


class Pieces:
    """A vocabulary with its scores, byte pieces and the segment table."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        scores = [model.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = all(scores[i] == int(scores[i]) for i in plain) and len({scores[i] for i in plain}) == len(plain)
        width = math.log(max(2, size))
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {p: -math.log((2.7 - scores[i]) * width) if ranked else scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.fallback = min(self.scores.values(), default=0.0) - 10.0
        # Every beginning of a piece: its log probability, or None if it is no piece itself.
        self.reach: dict[str, float | None] = {p[:n]: None for p in self.ids for n in range(1, len(p))}
        self.reach |= self.scores
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.out = [b""] * size
        for p, i in self.ids.items():
            self.out[i] = p.translate(SWAP).encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        hashed = {}
        for p, i in self.ids.items():
            value = 0
            for c in p:
                value = (value * int(BASE) + ord(c) + 1) & TOP
            hashed[value] = (self.scores[p], i)
        self.keys = np.array(sorted(hashed), np.uint64)
        self.values = np.array([hashed[int(k)][0] for k in self.keys])
        self.key_ids = np.array([hashed[int(k)][1] for k in self.keys], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * MIX) >> np.uint64(44)] = True
        self.stops = self._stops()
        self.table = Table()

    def _stops(self) -> np.ndarray:
        """Those of the signs ``.,;:!?`` that no piece has behind a Latin letter."""
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        known = [c for c in ".,;:!?" if not any(pair[1] == c and LETTER[min(256, ord(pair[0]))] for pair in inside)]
        self.lines = not any("\n" in pair for pair in inside)
        return characters(*[(ord(c), ord(c)) for c in known])

    def cut_segments(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of every segment, and of every text among the segments; ``ends`` are the texts' ends.

        Segments lie between places that no piece spans: before a run of marks, around a line break and before
        a sign that no piece has behind a letter.
        """
        begin = np.zeros(len(codes), bool)
        begin[0] = True
        begin[ends[:-1]] = True
        kind, mark = np.minimum(codes, 256), codes == ord(MARK)
        begin[1:] |= mark[1:] & ~mark[:-1]
        begin[1:] |= self.stops[kind[1:]] & LETTER[kind[:-1]]
        if self.lines:
            line = kind == 10
            begin |= line
            begin[1:] |= line[:-1]
        begins = np.flatnonzero(begin)
        return begins, np.searchsorted(begins, np.concatenate(([0], ends[:-1])))

    def stand_in(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary."""
        raw = char.translate(SWAP).encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def stream(self, text: str):
        """Yields committed lists of ids for marked text."""
        reach, longest, fallback, far = self.reach, self.longest, self.fallback, float("-inf")
        base, best, back = 0, [0.0], [0]  # for boundaries base, base + 1, ...
        for start in range(len(text)):
            score = best[start - base]
            for end in range(start + 1, min(start + longest, len(text)) + 1):
                value = reach.get(text[start:end], far if end > start + 1 else fallback)
                if value is far:
                    break  # no piece begins like this
                if end - base == len(best):
                    best.append(far)
                    back.append(start)
                if value is not None and score + value > best[end - base]:
                    best[end - base], back[end - base] = score + value, start
                elif value is None and end == start + 1 and score + fallback > best[end - base]:
                    best[end - base], back[end - base] = score + fallback, start
            done = start + 1
            if done == len(text) or (done - base >= 4 * longest and done % longest == 0):
                alive = {at + base for at in range(done - base, len(best)) if best[at] > far}
                while len(alive) > 1:  # follow the farthest path back until all meet
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last - base])
                meet = alive.pop()
                if meet > base:
                    yield self._path(text, base, meet, back)
                    best, back, base = best[meet - base :], back[meet - base :], meet

    def _path(self, text: str, base: int, end: int, back: list[int]) -> list[int]:
        found = []
        while end > base:
            start = back[end - base]
            piece = text[start:end]
            known = self.ids.get(piece)
            found.append(self.stand_in(piece) if known is None else [known])
            end = start
        return [i for part in reversed(found) for i in part]

    def _short(self, text: str) -> bytes:
        """The same search without a window, for segments that fit into one."""
        reach, fallback, size = self.reach.get, self.fallback, len(text)
        best, back = [float("-inf")] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            score, end = best[start], start + 1
            value = reach(text[start], fallback)
            total = score + (fallback if value is None else value)
            if total > best[end]:
                best[end], back[end] = total, start
            while end < size:
                end += 1
                value = reach(text[start:end], 0)
                if value is None:
                    continue
                if value == 0:
                    break
                if score + value > best[end]:
                    best[end], back[end] = score + value, start
        parts, end, coded = [], size, self.coded
        while end:
            piece = text[back[end] : end]
            parts.append(coded.get(piece) or np.array(self.stand_in(piece), "<i4").tobytes())
            end = back[end]
        return b"".join(parts[::-1])

    def _same_length(self, texts: list[str]) -> list[bytes]:
        """The search of :meth:`_short` for many segments of one length at once."""
        count, size, none = len(texts), len(texts[0]), float("-inf")
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(count, size).astype(np.uint64)
        hashes, power = [np.zeros(count, np.uint64)], [np.uint64(1)]
        for i in range(size):
            hashes.append(hashes[-1] * BASE + codes[:, i] + np.uint64(1))
            power.append(np.uint64(int(power[-1]) * int(BASE) & TOP))
        best, back, which = [np.zeros(count)], [None], [None]
        for end in range(1, size + 1):
            top, link, piece = np.full(count, none), np.zeros(count, np.int64), np.full(count, -1, np.int64)
            for start in range(max(0, end - self.longest), end):
                value = hashes[end] - hashes[start] * power[end - start]
                rows = np.flatnonzero(self.maybe[(value * MIX) >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.keys, value[rows]), len(self.keys) - 1)
                known = self.keys[at] == value[rows]
                rows, at = rows[known], at[known]
                total = best[start][rows] + self.values[at]
                better = total > top[rows]
                rows, at = rows[better], at[better]
                top[rows], link[rows], piece[rows] = total[better], start, self.key_ids[at]
            lost = top == none  # only a stand-in reaches this boundary
            top[lost], link[lost] = best[end - 1][lost] + self.fallback, end - 1
            best.append(top)
            back.append(link)
            which.append(piece)
        back[0] = which[0] = np.zeros(count, np.int64)
        links, names = np.stack(back), np.stack(which)
        ends, line = np.full(count, size), np.arange(count)
        ids, used, whole = np.zeros((count, size), "<i4"), np.zeros(count, np.int64), np.ones(count, bool)
        while (ends > 0).any():
            going = line[ends > 0]
            found = names[ends[going], going]
            used[going] += 1
            ids[going, size - used[going]] = found
            whole[going] &= found >= 0
            ends[going] = links[ends[going], going]
        return [ids[i, size - used[i] :].tobytes() if whole[i] else self._short(t) for i, t in enumerate(texts)]

    def _new_segments(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of segments; short ones of one length are searched together."""
        found: list = [None] * len(segments)
        lengths: dict[int, list[int]] = {}
        for n, segment in enumerate(segments):
            if len(segment) <= TOGETHER:
                lengths.setdefault(len(segment), []).append(n)
            elif len(segment) <= LONGEST:
                found[n] = self._short(segment)
            else:
                found[n] = np.array([i for part in self.stream(segment) for i in part], "<i4").tobytes()
        for places in lengths.values():
            for n, ids in zip(places, self._same_length([segments[n] for n in places])):
                found[n] = ids
        return [np.frombuffer(ids, np.uint32) for ids in found]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return next(iter(self.encode_all([text])))

    def encode_all(self, texts):
        """The ids of many texts, taken together in groups of about a megabyte."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= 1 << 20:
                yield from self._encode_group(group)
                group, size = [], 0
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]):
        if not self.cuts:
            yield from (b"".join(np.array(part, "<i4").tobytes() for part in self.stream(marked(t))) if t else b"" for t in texts)
            return
        filled = [marked(t) for t in texts if t]
        coded = iter(())
        if filled:
            joined = "".join(filled)
            codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
            begins, places = self.cut_segments(codes, np.cumsum([len(t) for t in filled]))
            if self.table.full():
                self.table = Table()
            coded = iter(self.table.encode(joined, codes, begins, places, self._new_segments))
        for text in texts:
            yield next(coded) if text else b""

    def decode(self, ids) -> str:
        out = self.out
        return b"".join([out[i] for i in ids]).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encoder(path: str):
    """Column function: struct of ``ids``, ``n`` and ``crc32`` (of the ids as little-endian 32-bit integers)."""

    def run(texts: pa.Array) -> pa.Array:
        pieces = load(path)
        parts = list(pieces.encode_all(t.as_py() for t in texts))
        sizes = np.fromiter((len(p) // 4 for p in parts), np.int32, len(parts))
        ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), ids)
        sums = pa.array([zlib.crc32(p) for p in parts], pa.int64())
        return pa.StructArray.from_arrays([lists, pa.array(sizes.astype(np.int64)), sums], ["ids", "n", "crc32"])

    return arrow(run, "struct<ids array<int>, n long, crc32 long>")


def decoder(path: str):
    """Column function: the text of an array of ids."""

    def run(lists: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([pieces.decode(ids.as_py() or ()) for ids in lists], pa.string())

    return arrow(run, "string")


def coder(path: str):
    """Column function: struct of ``ids``, ``n``, ``crc32`` and ``text``, what the ids decode to, in one worker per task."""

    def run(texts: pa.Array) -> pa.Array:
        pieces = load(path)
        ids, counts, sums, decoded = [], [], [], []
        for raw in pieces.encode_all(t.as_py() for t in texts):
            own = np.frombuffer(raw, "<i4")
            ids.append(own)
            counts.append(len(own))
            sums.append(zlib.crc32(raw))
            decoded.append(pieces.decode(own.tolist()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.StructArray.from_arrays([lists, pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(decoded, pa.string())], ["ids", "n", "crc32", "text"])

    return arrow(run, "struct<ids array<int>, n long, crc32 long, text string>")


def with_ids(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with a column of piece ids in place of any of that name."""
    return documents.withColumn(ids, encoder(path)(F.col(text))["ids"])


def round_trip(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and checksum of every text's ids, and the digest of what they decode to."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(key, F.sha2("text", 256).alias("sha"), encoder(path)(F.col("text")).alias("e"))
    rows = rows.select(key, "sha", "e.n", "e.crc32", decoder(path)(F.col("e.ids")).alias("decoded"))
    decoded = F.sha2("decoded", 256)
    return rows.select(
        key,
        F.col("n").alias("n_pieces"),
        F.col("crc32").alias("ids_crc32"),
        F.length("decoded").cast("bigint").alias("n_chars"),
        decoded.alias("decoded_sha256"),
        (decoded == F.col("sha")).alias("exact"),
    )


@register("op10_pieces")
def op10_pieces(spark, folder):
    """Every document encoded to piece ids and decoded again."""
    return round_trip(table(spark, folder, "documents"), vocabulary_path(MODEL))
