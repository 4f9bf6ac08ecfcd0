"""SimHash near duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most
two bits agree on at least two whole blocks, so they share one of the six pairs of blocks, and these
32-bit keys are joined. Equal fingerprints are one row before that, so copies cost nothing.

A key that more than ``hot`` different fingerprints share (large groups of near copies) would
give quadratically many pairs. Its fingerprints meet at midpoints instead: each is sent to
itself and to its 32 neighbours at one bit outside the shared blocks. Two fingerprints
at two or fewer bits have a midpoint in common, and any two at a midpoint are within two bits, so a
star per midpoint links the same components with a linear number of rows.

Cases: a NULL or empty text, or one of white space only, has fingerprint zero and is linked like any
other. A text with fewer words than the shingle is one shingle. Rows with equal doc_ids stay
separate rows with one fingerprint each; a NULL doc_id names no component and counts last among
ties. An empty table gives no rows. Other columns are ignored (or kept by ``near_dedup``).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, fresh, register, table, trim
from paperloom.llm.graph import connected_components
from paperloom.operators.numbering import numbered, small
from paperloom.session import discard, sweep_later, write_through

BLOCK = 16
PAIRS = list(combinations(range(4), 2))
MASK = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words, A-Z lower-cased; repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8"))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(width: int):
    """Column function: the signed 64-bit fingerprint of a text column."""

    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t.as_py(), width)) for t in texts], pa.int64())

    return arrow(simhash, "bigint")


def links(prints: DataFrame, hot: int = 64) -> DataFrame:
    """``a, b`` pairs of different fingerprints whose closure is that of all pairs at two or fewer bits.

    ``prints`` has one column ``fp`` with distinct values. For keys of at most ``hot`` fingerprints
    all verified pairs are given; for the others the stars over midpoints.
    """
    masks = [sum(0xFFFF << (BLOCK * i) for i in pair) for pair in PAIRS]
    keys = F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.key")
    sizes = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = write_through(keyed.join(sizes, ["pair", "key"]), "blocks")

    few = shared.where(F.col("n") <= hot)
    other = few.select("pair", "key", F.col("fp").alias("b"))
    pairs = few.select("pair", "key", F.col("fp").alias("a")).join(other, ["pair", "key"])
    close = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")

    free = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << j)) for j in range(64) if not (m >> j) & 1]) for m in masks]), F.col("pair") + 1)
    met = shared.where(F.col("n") > hot).select("fp", F.explode(free).alias("flip"))
    met = met.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp").distinct()
    centre = met.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = met.join(centre, "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    return close.unionAll(stars).distinct()


def components(prints: DataFrame, hot: int = 64) -> DataFrame:
    """``fp, root``: fingerprints linked at two or fewer bits share a root; lone ones are left out."""
    return connected_components(links(prints, hot), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(documents: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text", hot: int = 64) -> DataFrame:
    """``key, fp, component_id`` of every row; the component is named by its smallest key."""
    marked = write_through(documents.select(F.col(key).alias("id"), fingerprints(width)(F.col(text)).alias("fp")), "prints")
    parts = components(marked.select("fp").distinct(), hot)
    classes = marked.groupBy("fp").agg(F.min("id").alias("low")).join(parts, "fp", "left")
    classes = classes.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


def wide_fingerprints(width: int, words: int):
    """Column function: a fingerprint of ``words`` x 64 bits as an array of longs, one bit per mixed hash bit."""
    odd = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & MASK for i in range(words)], np.uint64)

    def bits_of(text: str | None) -> np.ndarray:
        hashes = np.unique(shingle_hashes(text, width))
        total = np.zeros(words * 64, np.int64)
        for at in range(0, len(hashes), 4096):
            mixed = hashes[at : at + 4096, None] * odd
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            total += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        return np.packbits(total * 2 > len(hashes)).view(np.int64)

    def wide(texts: pa.Array) -> pa.Array:
        return pa.array([bits_of(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return arrow(wide, "array<bigint>")


def agreement(similarity: float) -> float:
    """The share of equal bits of two SimHashes of sets with this Jaccard likeness."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def block_shape(texts: int, similarity: float, missed: float = 1e-3) -> tuple[int, int]:
    """Width and number of blocks for a number of texts.

    A block has eight bits more than are needed to number the texts, so unrelated texts seldom share one however
    many there are, and the blocks are as many as leave a pair at ``similarity`` without a common one with
    probability ``missed`` if blocks are independent.
    """
    bits = min(32, max(16, math.ceil(math.log2(max(2, texts))) + 8))
    return bits, math.ceil(math.log(1 / missed) / agreement(similarity) ** bits)


def block_values(words: int, bits: int, count: int, slices: int, step: int = 1024):
    """From (id, fp) rows: per block and slice, the values that up to ``step`` texts of consecutive ids have there.

    The bits are cut into blocks, as often as it takes for ``count``, each time in another fixed order. A
    slice is a remainder of the values; its rows also tell which texts they are.
    """

    def run(batches):
        draw, each = np.random.default_rng(7), words * 64 // bits
        orders = [draw.permutation(words * 64)[: each * bits] for _ in range(math.ceil(count / each))]
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = batch.column("fp").flatten().to_numpy().reshape(-1, words)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(ids) != 1) + 1, [len(ids)]))
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for at in range(begin, end, step):
                    found = [[], [], [], [], []]
                    spread = np.unpackbits(np.ascontiguousarray(rows[at : min(end, at + step)]).view(np.uint8), axis=1)
                    for turn, order in enumerate(orders):
                        values = (spread[:, order].reshape(len(spread), each, bits).astype(np.int64) @ weight).astype("<u4").T
                        for block in range(turn * each, min(count, (turn + 1) * each)):
                            own = np.ascontiguousarray(values[block - turn * each])
                            part = own % slices
                            for slice_ in range(slices):
                                some = np.flatnonzero(part == slice_) if slices > 1 else None
                                row = (block, slice_, int(ids[at]), (own if some is None else own[some]).view("<i4"), some)
                                for column, value in zip(found, row):
                                    column.append(value)
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["block", "slice", "base", "values", "places"])
            trim()

    return run


PACKED = "block int, slice int, base long, values array<int>, places array<int>"


def entries(packed: DataFrame, slices: int) -> DataFrame:
    """``key, id`` from packed block values; a key is the number of the block and its value."""
    if slices == 1:  # the values are those of all texts of the row
        each = packed.select("block", "base", F.posexplode("values").alias("place", "value"))
    else:
        each = packed.select("block", "base", F.explode(F.arrays_zip("places", "values")).alias("e")).select("block", "base", F.col("e.places").alias("place"), F.col("e.values").alias("value"))
    key = F.shiftleft(F.col("block").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return each.select(key.alias("key"), (F.col("base") + F.col("place")).alias("id"))


def _sharing(batches):
    """From (key, id) rows in order: those whose key is shared, with the first id of the key and their place in it."""
    key = lead = None  # the group at hand; ``place`` of its members have been seen
    place, held = 0, False
    for part in batches:
        keys, ids = part.column("key").to_numpy(), part.column("id").to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(begin, len(keys)))
        group = np.repeat(np.arange(len(begin)), size)
        leads, places = ids[begin][group], np.arange(len(keys)) - begin[group]
        shared = (size > 1)[group]
        extra = []
        if len(keys) and keys[0] == key:
            first = group == 0
            leads[first], places[first], shared[first] = lead, places[first] + place, True
            if held:  # the first member was alone until now
                extra = [(key, lead, lead, 0)]
        if len(keys):
            key, lead, place = int(keys[-1]), int(leads[-1]), int(places[-1]) + 1
            held = not shared[-1]
        columns = [np.concatenate((np.array([e[i] for e in extra], np.int64), c[shared])) for i, c in enumerate((keys, ids, leads, places))]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "lead", "place"])


def _signs(cell):
    """One row of +1 and -1 for each fingerprint of a cell."""
    return np.unpackbits(np.array(cell["fp"].tolist(), np.int64).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _cell_links(limit: int):
    """Near groups inside one cell of a large key: a forest of pairs within ``limit`` bits between groups.

    Breadth first over groups: the members of those reached are compared with the members of the others.
    """

    def run(cell):
        import pandas as pd

        cell = cell.drop_duplicates("id").sort_values("id")
        groups, own = np.unique(cell["component"].to_numpy(), return_inverse=True)
        links = [np.zeros((0, 2), np.int64)]
        if len(groups) > 1:
            signs = _signs(cell)
            far = signs.shape[1] - 2 * limit
            left = np.arange(len(own))
            while len(left):
                start = own[left[0]]
                reached, left = left[own[left] == start], left[own[left] != start]
                while len(reached) and len(left):
                    near = signs[reached] @ signs[left].T >= far
                    hit = near.any(axis=0)
                    found, first = np.unique(own[left[hit]], return_index=True)
                    parents = reached[near[:, hit].argmax(axis=0)][first]
                    links.append(np.stack((groups[own[parents]], groups[found]), axis=1))
                    more = np.isin(own[left], found)
                    reached, left = left[more], left[~more]
        trim()
        return pd.DataFrame(np.concatenate(links), columns=["a", "b"])

    return run


def _small_links(limit: int, hot: int):
    """From (key, component, fp) rows in order of their key: near groups inside keys of at most ``hot`` texts, a forest per batch.

    Each text is compared with those up to ``hot`` - 1 places behind it, so pairs stay inside the batch, which takes
    time in proportion to its rows and gives fewer links than it has groups.
    """

    def run(batches):
        held = None  # the last rows of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column("key").to_numpy(), batch.column("component").to_numpy()]
            rows.append(batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))
            keys, groups, prints = rows if held is None else (np.concatenate(c) for c in zip(held, rows))
            held = [c[len(keys) - min(len(keys), hot - 1) :] for c in (keys, groups, prints)]
            found = [np.zeros((0, 2), np.int64)]
            for step in range(1, hot):
                at = np.flatnonzero((keys[step:] == keys[:-step]) & (groups[step:] != groups[:-step]))
                at = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1, dtype=np.int64) <= limit]
                found.append(np.sort(np.stack((groups[at], groups[at + step]), axis=1), axis=1))
            above, links = {}, []

            def root(node, above=above):
                while (up := above.get(node, node)) != node:
                    above[node] = node = above.get(up, up)
                return node

            for a, b in np.unique(np.concatenate(found), axis=0).tolist():
                x, y = root(a), root(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    links.append((a, b))
            links = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        trim()

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _cell_confirmed(width: int, similarity: float, limit: int):
    """Exact links between the groups in one cell of a family; pairs that are linked by others are not compared."""

    def run(cell):
        import pandas as pd

        cell = cell.drop_duplicates("id").sort_values("id")
        ids, group, texts = cell["id"].to_numpy(), cell["component"].to_numpy(), cell["text"].tolist()
        signs = _signs(cell)
        near = np.argwhere(np.triu(signs @ signs.T >= signs.shape[1] - 2 * limit, 1) & (group[:, None] != group[None, :]))
        above, sets, links = {}, {}, []

        def root(node):
            while (up := above.get(node, node)) != node:
                above[node] = node = above.get(up, up)
            return node

        def shingles(i):
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(texts[i], width))
            return sets[i]

        for i, j in near.tolist():
            a, b = root(group[i]), root(group[j])
            if a != b:
                x, y = shingles(i), shingles(j)
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and jaccard(x, y) >= similarity - 1e-9:
                    above[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        sets.clear()
        trim()
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def likeness(width: int):
    """Column function: the Jaccard likeness of two texts' sets of shingles; two blank texts are equal."""

    def compared(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([jaccard(*(np.unique(shingle_hashes(t.as_py(), width)) for t in pair)) for pair in zip(left, right)], pa.float64())

    return arrow(compared, "double")


def confirmed(pairs: DataFrame, texts, width: int, similarity: float, salts: int = 64) -> DataFrame:
    """The distinct ``a, b`` pairs whose texts have a likeness of ``similarity`` or more.

    ``texts(ids)`` gives (id, text) of the ids asked for. A text with many partners is sent to them in ``salts`` shares.
    """
    salted = pairs.withColumn("u", F.pmod(F.xxhash64("b"), F.lit(salts))).withColumn("v", F.pmod(F.xxhash64("a"), F.lit(salts)))
    salted = write_through(salted, "pairs")
    asked = salted.select(F.col("a").alias("id")).unionAll(salted.select("b")).distinct()
    known = write_through(texts(asked), "texts")
    left = known.join(salted.select(F.col("a").alias("id"), "u").distinct(), "id").select(F.col("id").alias("a"), "u", F.col("text").alias("x"))
    right = known.join(salted.select(F.col("b").alias("id"), "v").distinct(), "id").select(F.col("id").alias("b"), "v", F.col("text").alias("y"))
    both = salted.join(left, ["a", "u"]).join(right, ["b", "v"])
    found = write_through(both.where(likeness(width)(F.col("x"), F.col("y")) >= similarity - 1e-9).select("a", "b"), "links")
    discard(known)
    discard(salted)
    return found


def _apart(pairs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``pairs`` (a, b) with ``far``, the number of bits in which their fingerprints differ."""
    left, right = classes.select(F.col("id").alias("a"), F.col("fp").alias("x")), classes.select(F.col("id").alias("b"), F.col("fp").alias("y"))
    far = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(words)), F.lit(0))
    return pairs.join(left, "a").join(right, "b").withColumn("far", far).drop("x", "y")


def close_texts(classes: DataFrame, texts, width: int, similarity: float, words: int, limit: int, hot: int, cell: int, slice_rows: int = 1 << 22) -> DataFrame:
    """``a, b`` links between texts (``id``, ``fp``) that share a block, differ in at most ``limit`` bits and are alike.

    First every text is held against one other: of the first texts of its keys, the one with which it shares
    most keys. These links, at most one per text, join most copies. From then on only pairs of different groups matter.
    Keys whose texts are all in one group are done. In the others, pairs of different groups within
    ``limit`` bits make families of groups (small keys in the order of keys, each text against the few behind it, keys of
    more than ``hot`` texts in a grid of cells; both give a forest of their groups). A family is dealt out over parts of an eighth of
    ``cell`` texts, and each part confirms exact links until its groups are joined. Families of one part are done then. Of the others, those
    still of several groups are sent once to each cell of two parts; cells of one group
    are left out. So texts move per cell and not per pair, and pairs inside a group never appear.
    """
    size = classes.count()
    bits, count = block_shape(size, similarity)
    slices = 1 << max(0, math.ceil(math.log2(max(1, size / slice_rows))))
    packed = classes.select("id", "fp").mapInArrow(block_values(words, bits, count, slices), PACKED).repartition("block", "slice")
    shared = write_through(entries(packed, slices).sortWithinPartitions("key", "id").mapInArrow(_sharing, "key long, id long, lead long, place long"), "blocks")

    star = shared.where("place > 0").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n"))
    best = star.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("back"))).alias("best")).select((-F.col("best.back")).alias("a"), "b")
    nearest = _apart(best, classes, words).where(F.col("far") <= limit)
    links = confirmed(nearest.select("a", "b"), texts, width, similarity)
    found = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    named = write_through(classes.join(found, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("component")), "groups")

    group = small(named.select("id", "component"))
    members = shared.select("key", "id").join(group, "id")
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    members = write_through(members.join(mixed, "key"), "mixed")
    few, many = members.where(F.col("n") <= hot), members.where(F.col("n") > hot)
    few = few.select("key", "id", "component").join(named.select("id", "fp"), "id").select("key", "component", "fp")
    near = few.repartition("key").sortWithinPartitions("key").mapInArrow(_small_links(limit, hot), "a long, b long")

    places = write_through(numbered(many.select(F.col("key").cast("string").alias("grp"), "key", "id", "component"), "grp", ["component", "id"]), "places")
    grid = _grid(places, cell, "key").join(named.select("id", "fp"), "id")
    forests = grid.groupBy("key", "i", "j").applyInPandas(_cell_links(limit), "a long, b long")
    families = connected_components(near.unionAll(forests), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("family"))

    relatives = named.join(families, "component").select(F.col("family").cast("string").alias("grp"), F.col("family").alias("key"), "id", "component")
    relatives = write_through(numbered(relatives, "grp", ["id"]), "relatives")
    known = write_through(texts(relatives.select("id")).join(named.select("id", "fp"), "id"), "known")
    confirm = _cell_confirmed(width, similarity, limit)
    dealt = relatives.withColumn("part", _part(cell // 8)).join(known, "id")
    second = write_through(dealt.groupBy("key", "part").applyInPandas(confirm, "a long, b long"), "links")

    found = connected_components(links.unionAll(second), "a", "b").withColumnRenamed("node", "id")
    left = relatives.where(F.col("total") > cell // 8).select("grp", "key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rest = write_through(numbered(left.join(mixed, "key"), "grp", ["component", "id"]), "rest")
    third = _grid(rest, cell // 8, "key").join(known, "id").groupBy("key", "i", "j").applyInPandas(confirm, "a long, b long")
    third = write_through(third, "links")
    for spent in (shared, named, members, places, relatives, known, rest):
        discard(spent)
    return links.unionAll(second).unionAll(third)


def _part(cell: int):
    """The part of ``cell`` numbered rows that a row is in."""
    return F.expr(f"pos div {max(1, cell)}")


def _grid(placed: DataFrame, cell: int, key: str) -> DataFrame:
    """``key, i, j, id, component``: members in parts of ``cell``, sent to every pair of parts of more than one group.

    A key of one part is one cell as it is.
    """
    one = F.col("total") <= max(1, cell)
    alone = placed.where(one).select(key, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "id", "component")
    members = placed.where(~one).withColumn("part", _part(cell))
    parts = members.groupBy(key, "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = parts.select(key, F.col("part").alias("i"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    right = parts.select(key, F.col("part").alias("j"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    cells = left.join(right, key).where("i <= j AND NOT (l1 = h1 AND l2 = h2 AND l1 = l2)").select(key, "i", "j")
    sent = cells.select(key, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    return alone.unionAll(members.join(sent, [key, "part"]).select(key, "i", "j", "id", "component"))


def near_dedup(
    documents: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    words: int = 24,
    hot: int = 8,
    cell: int = 1024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``documents``.

    Texts are linked if the Jaccard likeness of their sets of ``width``-word shingles is
    ``similarity`` or more. At 0.8 two SimHashes differ in 15 of 100 bits, too many for 64 bits and
    two flips, so fingerprints of ``words`` x 64 bits are taken: the expected share of different
    bits is acos(2s / (1 + s)) / pi, with an error of about 0.01 at 1,536 bits. Texts that share a block
    (``block_shape``) and differ in at most 100 bits more than expected (seven times the
    error; texts of four and five shingles need it) are candidates, and the exact likeness decides.
    Exact copies are one row before that. The row with the smallest key stays (NULL keys last).

    Rows are known by a digest of text and key, so texts are not written again. What the result reads is
    deleted when the next stage calls ``session.sweep``.
    """
    own = documents.columns
    cls, ident = fresh(documents, "cls"), fresh(documents, "ident")
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    marked = documents.withColumn(cls, digest)
    marked = marked.withColumn(ident, F.unhex(F.md5(F.concat(F.hex(cls), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("-"))).cast("binary"))))
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(ident).alias("ident"))
    rows = marked.select(F.col(cls).alias("cls"), rank.alias("rank"), wide_fingerprints(width, words)(F.col(text)).alias("fp"))
    copies = rows.groupBy("cls", "rank").agg(F.count("*").alias("n"), F.first("fp").alias("fp"))
    classes = copies.groupBy("cls").agg(F.min(F.struct("rank", "n")).alias("best"), F.first("fp").alias("fp"))
    classes = write_through(classes.select(F.monotonically_increasing_id().alias("id"), "best.rank", "best.n", "fp"), "classes")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").select("id", F.col("rank.ident").alias(ident))
        return marked.select(ident, F.col(text).alias("text")).join(small(write_through(wanted, "wanted")), ident).dropDuplicates(["id"]).select("id", "text")

    expected = words * 64 * (1 - agreement(similarity))
    limit = int(expected + words * 64 * 0.065 + 0.5)
    links = close_texts(classes.select("id", "fp"), texts, width, similarity, words, limit, hot, cell)
    found = connected_components(links, "a", "b")
    named = classes.select("id", "rank", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    first = named.groupBy(F.coalesce("component", "id").alias("group")).agg(F.min(F.struct("rank", "n")).alias("best"))
    kept = write_through(first.select(F.col("best.rank.ident").alias(ident), F.col("best.n").alias("n")), "kept")
    discard(classes)
    sweep_later(kept)
    single = marked.join(small(kept.where("n = 1").select(ident)), ident, "left_semi").select(*own)
    # Of rows equal in key and text one stays, whichever; they are combined before they are shuffled.
    again = marked.join(small(kept.where("n > 1").select(ident)), ident, "left_semi")
    again = again.groupBy(ident).agg(F.first(F.struct(*own)).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in own])
    return single.unionAll(again)


@register("op5_simhash")
def op5_simhash(spark, folder):
    """Fingerprints over three words and the components of those within two bits."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
