"""Token ids in files of patched frame-of-reference blocks.

Texts are ranged and sorted by document id, encoded once, and written as files of some million ids. A
file has blocks of 512 ids. Of each block the minimum is subtracted; the rest is packed at the
width of a percentile of its bit lengths (90, 95, 98 or 100, whichever gives the fewest bytes); the
high bits of longer values are exceptions in a list. An index of block starts and the documents'
sizes let a reader take single documents without the rest.

Tasks write files under names of their own attempt and return a manifest row for each; only files
in the manifest count, so a lost or repeated task leaves no trace. Ids before a file are summed
over the manifest in two levels (tasks, then files).

A text is encoded by units: words that the pre-tokenizer takes as one in any surroundings, and what lies
between. Units repeat, so their ids are kept in a bounded table per worker, found by a 64-bit hash for a
megabyte of text at once; new words are encoded together. The ids are those of the whole text (tests
compare; the characters of a unit are compared on every hit).

Cases: a NULL or empty text has only the end id. Documents are ordered by id, NULL ids first, equal
ids by the text's hash and text; repeated rows are each stored. An empty table gives no files and no rows. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.base import register, ship, table, trim
from paperloom.llm.pieces import vocabulary_path
from paperloom.llm.units import LETTER, Table, characters
from paperloom.session import shared_dir, write_through

VOCABULARY = "byte_bpe_50k.json"
MAGIC, BLOCK, END = b"PFOR", 512, 0
PERCENTILES = (0.90, 0.95, 0.98, 1.0)
EXCEPTION = 6  # bytes: place and high bits
FILE_IDS = 4 << 20
GROUP = 1 << 20
HEAD = "<4sIQQQ"  # magic, block size, documents, ids, blocks
BLOCK_HEAD = "<IBxH"  # minimum, width, exceptions


# --- format -----------------------------------------------------------------------------------


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


@functools.cache
def _short_lengths() -> np.ndarray:
    return _bit_lengths(np.arange(1 << 16))


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values of ``width`` bits as rows of bytes."""
    rows, size = values.shape
    if width == 16:
        return values.astype("<u2").view(np.uint8).reshape(rows, -1)
    kind, bits = (">u2", 16) if width < 16 else (">u4", 32)
    spread = np.unpackbits(values.astype(kind).view(np.uint8).reshape(rows * size, bits // 8), axis=1)
    return np.packbits(spread[:, bits - width :].reshape(rows, size * width), axis=1)


def _unpack(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    rows = len(packed)
    if width == 16:
        return packed.view("<u2").astype(np.uint32).reshape(rows, size)
    kind, bits = (">u2", 16) if width < 16 else (">u4", 32)
    spread = np.zeros((rows * size, bits), np.uint8)
    spread[:, bits - width :] = np.unpackbits(packed, axis=1, count=size * width).reshape(rows * size, width)
    return np.packbits(spread, axis=1).view(kind).astype(np.uint32).reshape(rows, size)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a sequence of ids; the last one is filled up with its last id."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return []
    rows = np.pad(ids.astype(np.uint32), (0, count * BLOCK - len(ids)), mode="edge").reshape(count, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    lengths = _short_lengths()[delta] if delta.max() < 1 << 16 else _bit_lengths(delta)
    ordered = np.sort(lengths, axis=1)
    widths = ordered[:, [int(np.ceil(p * BLOCK)) - 1 for p in PERCENTILES]]
    over = np.stack([(ordered > widths[:, [i]]).sum(axis=1) for i in range(len(PERCENTILES))], axis=1)
    best = (widths.astype(np.int64) * (BLOCK // 8) + over * EXCEPTION).argmin(axis=1)
    line = np.arange(count)
    width, exceptions = widths[line, best], over[line, best]
    row, place = np.nonzero(lengths > width[:, None])
    high = (delta[row, place] >> width[row].astype(np.uint32)).astype("<u4")
    place, ends = place.astype("<u2"), np.cumsum(exceptions)
    blocks: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        group = np.flatnonzero(width == w)
        packed = _pack(delta[group] & np.uint32((1 << w) - 1), w) if w else np.zeros((len(group), 0), np.uint8)
        for at, part in zip(group.tolist(), packed):
            a, b = int(ends[at] - exceptions[at]), int(ends[at])
            blocks[at] = struct.pack(BLOCK_HEAD, int(low[at]), w, b - a) + place[a:b].tobytes() + high[a:b].tobytes() + part.tobytes()
    return blocks


def unpack_blocks(raw, starts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that begin at ``starts`` of ``raw``."""
    found = np.zeros((len(starts), BLOCK), np.uint32)
    groups: dict[int, tuple[list, list]] = {}
    patches = []
    for at, start in enumerate(starts.tolist()):
        low, width, exceptions = struct.unpack_from(BLOCK_HEAD, raw, start)
        body = start + struct.calcsize(BLOCK_HEAD) + EXCEPTION * exceptions
        found[at] = low
        if exceptions:
            patches.append((at, width, start + struct.calcsize(BLOCK_HEAD), exceptions))
        if width:
            places, parts = groups.setdefault(width, ([], []))
            places.append(at)
            parts.append(np.frombuffer(raw, np.uint8, width * BLOCK // 8, body))
    for width, (places, parts) in groups.items():
        found[places] += _unpack(np.stack(parts), width, BLOCK)
    for at, width, start, exceptions in patches:
        place = np.frombuffer(raw, "<u2", exceptions, start)
        found[at, place] += np.frombuffer(raw, "<u4", exceptions, start + 2 * exceptions) << np.uint32(width)
    return found.reshape(-1)


def file_bytes(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: head, documents (known key, key, size), index of block starts, blocks."""
    blocks = pack_blocks(ids)
    known = np.array([k is not None for k in keys], np.uint8).tobytes()
    names = np.array([k or 0 for k in keys], "<i8").tobytes()
    front = struct.calcsize(HEAD) + len(known) + len(names) + 8 * len(keys) + 8 * len(blocks)
    starts = front + np.cumsum([0] + [len(b) for b in blocks])[:-1]
    head = struct.pack(HEAD, MAGIC, BLOCK, len(keys), len(ids), len(blocks))
    return b"".join([head, known, names, sizes.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Reads a file's documents; blocks are unpacked as they are asked for."""

    def __init__(self, raw):
        self.raw = raw
        magic, block, documents, self.n_ids, blocks = struct.unpack_from(HEAD, raw, 0)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a file of token blocks")
        at = struct.calcsize(HEAD)
        known = np.frombuffer(raw, np.uint8, documents, at)
        names = np.frombuffer(raw, "<i8", documents, at + documents)
        self.keys = [int(n) if k else None for k, n in zip(known, names)]
        self.sizes = np.frombuffer(raw, "<u8", documents, at + 9 * documents).astype(np.int64)
        self.starts = np.frombuffer(raw, "<u8", blocks, at + 17 * documents).astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """A range of ids; only its blocks are read."""
        end = self.n_ids if end is None else end
        if end <= first:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-end // BLOCK)
        return unpack_blocks(self.raw, self.starts[low:high])[first - low * BLOCK : end - low * BLOCK]

    def document(self, number: int) -> np.ndarray:
        first = int(self.firsts[number])
        return self.ids(first, first + int(self.sizes[number]))


# --- encoding ---------------------------------------------------------------------------------


#: White space; what may stand behind a word (ASCII signs and white space) and before one without a
#: space (the same but the apostrophe, which may begin a contraction).
SPACE = characters((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0))
BEHIND = characters((9, 13), (28, 64), (91, 96), (123, 126))
BEFORE = characters((9, 38), (40, 64), (91, 96), (123, 126))


def cut_units(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of every unit, and of every text among the units; ``ends`` are the texts' ends.

    A word, with the space in front of it, is a unit where the pre-tokenizer takes it as one whatever else
    stands around it; what lies between words is one too.
    """
    kind = np.minimum(codes, 256)
    edge = np.zeros(len(codes) + 1, bool)  # a text begins here
    edge[0] = True
    edge[ends] = True
    letter = LETTER[kind]
    before = np.concatenate(([False], letter[:-1])) & ~edge[:-1]
    first = np.flatnonzero(letter & ~before)
    after = np.concatenate((letter[1:], [False])) & ~edge[1:]
    last = np.flatnonzero(letter & ~after) + 1
    closed = edge[last] | BEHIND[kind[np.minimum(last, len(kind) - 1)]]
    fresh = edge[first]
    prior = kind[np.maximum(first - 1, 0)]
    spaced = ~fresh & (prior == 32)
    twice = ~fresh & SPACE[prior] & (first > 1) & ~edge[np.maximum(first - 1, 0)] & SPACE[kind[np.maximum(first - 2, 0)]]
    good = closed & (fresh | spaced | (BEFORE[prior] & ~twice))
    marks = edge[:-1].copy()
    marks[(first - spaced)[good]] = True
    behind = last[good]
    marks[behind[behind < len(codes)]] = True
    begins = np.flatnonzero(marks)
    return begins, np.searchsorted(begins, np.concatenate(([0], ends[:-1])))


class Encoder:
    """A byte-level tokenizer with a table of units; ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.table = Table()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Words with their space in front, encoded as one text: a token that begins with a space begins a word."""
        if not words:
            return []
        [found] = self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(words):
            return [self.whole(w) for w in words]
        return np.split(ids, begins[1:])

    def encode_all(self, texts):
        """The ids of many texts, taken together in groups of about a megabyte."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]):
        plain = [t for t in texts if t and not any(s in t for s in self.special)]
        coded = iter(self._plain(plain) if plain else [])
        for text in texts:
            yield b"" if not text else self.whole(text).tobytes() if any(s in text for s in self.special) else next(coded)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        begins, text_units = cut_units(codes, ends)
        if self.table.full():
            self.table = Table()
        return self.table.encode(joined, codes, begins, text_units, self._new_units)

    def _new_units(self, units: list[str]) -> list[np.ndarray]:
        words = [n for n, u in enumerate(units) if u[0] == " " and LETTER[min(256, ord(u[-1]))]]
        parts: dict[int, np.ndarray] = dict(zip(words, self._words([units[n] for n in words]), strict=True))
        return [parts[n] if n in parts else self._long(unit) for n, unit in enumerate(units)]

    def _long(self, text: str) -> np.ndarray:
        """Any text; a long one in parts that end at single spaces between other characters."""
        parts, start = [], 0
        while start < len(text):
            end = start + (1 << 16)
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and text[end + 1 : end + 2].strip()):
                end += 1
            parts.append(self.whole(text[start:end]))
            start = end
        return np.concatenate(parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- writing and reading ----------------------------------------------------------------------


def _store(folder: str):
    """File system and path of a folder: an address such as hdfs:// or file://, or a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


MANIFEST = "task long, number int, file string, n_docs long, n_ids long, n_bytes long"


def write_tokens(documents: DataFrame, folder: str, path: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts to ``folder`` and returns the manifest, one row per file in order."""

    def write(batches):
        store, place = _store(folder)
        task = TaskContext.get()
        tail = np.array([end], "<u4").tobytes()
        keys, parts, held, number = [], [], 0, 0

        def flush():
            nonlocal keys, parts, held, number
            raw = file_bytes(keys, np.array([len(p) // 4 for p in parts]), np.frombuffer(b"".join(parts), "<u4"))
            name = f"ids-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.pfor"
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(raw)
            row = {"task": task.partitionId(), "number": number, "file": name, "n_docs": len(keys), "n_ids": held, "n_bytes": len(raw)}
            keys, parts, held, number = [], [], 0, number + 1
            del raw
            trim()
            return pa.RecordBatch.from_pylist([row], pa.schema([("task", pa.int64()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            texts = batch.column("text")
            for name, ids in zip(batch.column("key").to_pylist(), encoder(path).encode_all(t.as_py() for t in texts)):
                keys.append(name)
                parts.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= FILE_IDS:
                    yield flush()
        if keys:
            yield flush()

    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return write_through(ranged.mapInArrow(write, MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids in all files before each."""
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("task").orderBy("number")) - F.col("n_ids")
    return manifest.withColumn("own", own).join(before, "task").withColumn("start", F.col("base") + F.col("own"))


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def read(batches):
        store, place = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['file']}") as source:
                    found = TokenFile(source.read())
                ids = memoryview(found.ids().astype("<u4")).cast("B")
                sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(found.firsts.tolist(), found.sizes.tolist())]
                columns = [pa.array(found.keys, pa.int64()), pa.array(found.firsts + row["start"], pa.int64()), pa.array(found.sizes, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(spark)
    files = placed(manifest).select("file", "start", "n_bytes")
    total = manifest.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    parts = max(spark.sparkContext.defaultParallelism, total // (32 << 20))
    spread = files.repartition(int(parts), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


@register("op2_token_store")
def op2_token_store(spark, folder):
    """All documents as ids in files, read back."""
    target = new_folder(spark, "tokens")
    manifest = write_tokens(table(spark, folder, "documents"), target, vocabulary_path(VOCABULARY))
    return read_tokens(spark, manifest, target)
