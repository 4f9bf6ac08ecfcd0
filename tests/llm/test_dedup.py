"""SimHash groups, components, repeated strings and sketches against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from rows_llm import documents, empty, nasty, texts  # noqa: F401

from paperloom.llm import fingerprint, graph, simhash, suffix


def _groups(pairs, items):
    above = {i: i for i in items}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in pairs:
        above[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in items}


def _print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(documents, texts, hot):
    prints = {i: _print(t) for i, t in texts}
    ids = list(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2]
    wanted = _groups(pairs, ids)
    found = simhash.near_duplicates(documents, hot=hot).collect()
    assert {r["doc_id"]: (r["fp"] & simhash.MASK, r["component_id"]) for r in found} == {i: (prints[i], wanted[i]) for i in ids}


def test_links_at_midpoints(spark):
    """A crowd around one fingerprint, all in one block, and pairs at one to four bits."""
    draw = random.Random(5)
    crowd = {0x1234567800000000 ^ (1 << draw.randrange(32)) ^ (1 << draw.randrange(32)) for _ in range(150)}
    far = {0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F ^ 0x11, 0x0F0F0F0F0F0F0F0F ^ 0x1111}
    prints = sorted(crowd | far)
    pairs = [(a, b) for n, a in enumerate(prints) for b in prints[:n] if (a ^ b).bit_count() <= 2]
    wanted = Counter(_groups(pairs, prints).values())
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for hot in (16, 1000):
        found = simhash.components(table, hot).collect()
        sizes = Counter(r["root"] for r in found)
        assert sorted(sizes.values()) == sorted(n for n in wanted.values() if n > 1)


def test_simhash_nasty(nasty, empty):
    found = simhash.near_duplicates(nasty).collect()
    assert len(found) == nasty.count()
    blank = [r for r in found if r["fp"] == 0]
    assert {r["doc_id"] for r in blank} == {None, 2, 3, 4} and {r["component_id"] for r in blank} == {2}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, nasty, empty):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = [[draw.choice(words) for _ in range(300)] for _ in range(30)]
    rows = []
    for number, text in enumerate(base):
        rows.append((100 * number, " ".join(text)))
        for copy in range(3):
            near = list(text)
            near[draw.randrange(300)] = "changed"
            rows.append((100 * number + copy + 1, " ".join(near)))
    rows += [(5000 + n, " ".join(base[0][:n] + ["other"] + base[0][n + 1 :])) for n in range(80)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=8, cell=16).collect()
    assert sorted(r["doc_id"] for r in kept) == [100 * n for n in range(30)]
    kept = simhash.near_dedup(nasty)
    assert kept.columns == nasty.columns
    # Blank texts are one group, the rows of id 1 with equal texts another, and the two long texts.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 1), *[(False, i) for i in (2, 5, 7, 8, 9, 10)], (True, 0)]
    assert simhash.near_dedup(empty).count() == 0


def test_near_dedup_leaves_different_texts(documents, texts):
    shingles = {i: {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for i, t in texts for w in [t.lower().split()]}
    kept = {r["doc_id"] for r in simhash.near_dedup(documents).select("doc_id").collect()}
    likeness = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for i in shingles:
        best = max((likeness(i, j) for j in shingles if j != i), default=0)
        assert i in kept or best >= 0.75
    lost = [(a, b) for a in kept for b in kept if a < b and likeness(a, b) >= 0.85]
    assert not lost


@pytest.mark.parametrize("size", [100, 400])
def test_near_dedup_links_at_the_bound(spark, size):
    """Pairs just above a likeness of 0.8 are one group, pairs just below stay apart."""
    draw = random.Random(11)
    rows, wanted = [], {}
    for number in range(150):
        share = draw.uniform(0.77, 0.85)
        words = [f"w{draw.randrange(10**6)}" for _ in range(size + 4)]
        other = words[: int((size + 4) * 2 * share / (1 + share))]
        other += [f"v{draw.randrange(10**6)}" for _ in range(size + 4 - len(other))]
        a, b = (set(simhash.shingle_hashes(" ".join(w), 5).tolist()) for w in (words, other))
        wanted[number] = len(a & b) / len(a | b)
        rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(other))]
    for hot in (8, 1):
        kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        gone = {n for n in wanted if 2 * n + 1 not in kept}
        assert all(2 * n in kept for n in wanted)
        assert not [wanted[n] for n in gone if wanted[n] < 0.8]
        missed = [wanted[n] for n in set(wanted) - gone if wanted[n] >= 0.8]
        assert len(missed) <= 1  # 0.998 share a block at 0.8


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(7, 7), (None, 3)]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1501)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- repeated strings -------------------------------------------------------------------------


@pytest.mark.parametrize("symbols", [b"a", b"ab", b"abcdef\xfe\x01", b"banana mississippi"])
@pytest.mark.parametrize("size", [1, 2, 7, 60, 3000])
def test_suffix_array(symbols, size):
    draw = random.Random(size)
    raw = bytes(draw.choice(symbols) for _ in range(size))
    text = np.frombuffer(raw, np.uint8)
    order = suffix.suffix_array(text).tolist()
    assert sorted(order) == list(range(size))
    assert all(raw[a : a + 100] <= raw[b : b + 100] for a, b in zip(order, order[1:]))
    shared = suffix.common_prefixes(text, np.array(order))
    for a, b in zip(order, order[1:]):
        same = next((n for n, (x, y) in enumerate(zip(raw[a:], raw[b:])) if x != y), min(len(raw[a:]), len(raw[b:])))
        assert min(100, same) <= shared[b] <= 100 or size - max(a, b) < 100
        assert shared[b] == min(100, same) or same == size - max(a, b)


def _brute(rows):
    seen, found = set(), {}
    for key, text in sorted(set(rows)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        found[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


@pytest.mark.parametrize("settings", [{}, {"SHARD": 3000, "GROUP": 3, "ROWS": 2000, "PART": 600}])
def test_repeats_against_brute_force(spark, texts, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffix, name, value)
    draw = random.Random(2)
    source = [t for _, t in texts[:20]]
    rows = [(i, t) for i, t in texts]
    for i in range(150):
        parts = [draw.choice(source) for _ in range(3)]
        mixed = "".join(p[(a := draw.randrange(300)) : a + draw.randint(50, 400)] for p in parts)
        rows.append((1000 + i, draw.choice([mixed, "ab" * draw.randint(0, 300), "x" * draw.randint(0, 500), "é😀" * 60, draw.choice(source)])))
    rows.append((2000, ""))
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    wanted = _brute(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == wanted


def test_repeats_nasty(nasty, empty):
    found = suffix.remove_repeats(nasty).collect()
    assert len(found) == nasty.count()
    by_key = {}
    for r in found:
        by_key.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by_key[6][0][0] == by_key[6][0][1] == 300000  # the copy goes as a whole
    assert by_key[5][0] == (300000, 300000 - 25)  # it repeats itself
    assert by_key[2] == by_key[3] == [(0, 0)] and by_key[10] == [(3, 0)]
    assert suffix.remove_repeats(empty).count() == 0


# --- sketches ---------------------------------------------------------------------------------


def test_sketches(documents, texts, nasty, empty):
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(documents).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[key]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (text, edited))
        true = len(a & b) / min(len(a), len(b))
        errors.append(abs(row["near_edited"] - true))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert float(np.mean(errors)) < 0.08
    equal = {}
    for key, text in texts:
        assert equal.setdefault(text, found[key]["fingerprint"]) == found[key]["fingerprint"]
    assert len(fingerprint.fingerprints(nasty).collect()) == nasty.count()
    assert fingerprint.fingerprints(empty).count() == 0
    single = fingerprint.fingerprints(documents.where("doc_id = 0")).first()
    assert single["near_next"] == 1.0


def test_sketches_merge():
    draw = random.Random(1)
    for size in (3, 40, 2000):
        a, b = (" ".join(str(draw.randrange(500)) for _ in range(size)) for _ in range(2))
        both = np.union1d(simhash.shingle_hashes(a, 5), simhash.shingle_hashes(b, 5))
        kept = both[: max(16, int((both <= np.uint64(fingerprint.TOP // 8)).sum()))]
        assert (fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b)) == kept).all()


def test_near_dedup_of_families_at_the_bound(spark):
    """Large families around the bound: as many rows stay as groups of exact links, hot keys or not."""
    draw = random.Random(9)
    rows, wanted = [], 0
    for family, size in enumerate([60, 150, 250]):
        base = [f"f{family}w{i}" for i in range(120)]
        sets = []
        for _ in range(size):
            words = list(base)
            for at in draw.sample(range(120), draw.choice([0, 1, 2, 3])):
                words[at] = f"x{draw.randrange(10**6)}"
            sets.append(set(simhash.shingle_hashes(" ".join(words), 5).tolist()))
            rows.append((len(rows), " ".join(words)))
        above = list(range(size))

        def root(i, above=above):
            while above[i] != i:
                i = above[i]
            return i

        for i in range(size):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    above[root(i)] = root(j)
        wanted += len({root(i) for i in range(size)})
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, cell in ((8, 1024), (1, 64)):
        assert simhash.near_dedup(table, hot=hot, cell=cell).count() == wanted


def test_block_values_are_cut_and_joined(spark, monkeypatch):
    """Slices of blocks give the keys of whole blocks."""
    draw = np.random.default_rng(1)
    rows = [(i + (1 << 33 if i > 50 else 0), draw.integers(-(2**63), 2**63, 24).tolist()) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    table = spark.createDataFrame(rows, "id long, fp array<bigint>").repartition(3)
    found = []
    for slices in (1, 4):
        entries = simhash.entries(table.mapInArrow(simhash.block_values(24, 20, 100, slices), simhash.PACKED), slices)
        found.append(sorted(map(tuple, entries.collect())))
        shared = entries.repartition("key").sortWithinPartitions("key", "id").mapInArrow(simhash._sharing, "key long, id long, lead long, place long").collect()
        assert {(r["lead"], r["id"]) for r in shared if r["place"]} >= {(i, 200 + i) for i in range(20)}
    assert found[0] == found[1] and len(found[0]) == 100 * 100


def test_sharing_over_batches():
    """Groups that lie across batches come out once and whole."""
    keys = [1, 2, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for cuts in range(1, len(keys)):
        batches = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(keys[a : a + cuts]), simhash.pa.array(list(range(a, min(len(keys), a + cuts))))], ["key", "id"]) for a in range(0, len(keys), cuts)]
        found = sorted((r["key"], r["id"], r["lead"], r["place"]) for b in simhash._sharing(batches) for r in b.to_pylist())
        assert found == [(k, i, keys.index(k), i - keys.index(k)) for i, k in enumerate(keys) if keys.count(k) > 1]


def test_small_keys_over_batches():
    """All near groups of keys of at most ``hot`` texts are joined, wherever batches are cut."""
    draw = np.random.default_rng(3)
    base = draw.integers(-(2**63), 2**63, (6, 24))
    rows = []
    for key in range(60):
        for i in range(draw.integers(2, 9)):
            at = draw.integers(0, 6)
            rows.append((key, int(10 * at + draw.integers(0, 10)), (base[at] ^ (1 << int(draw.integers(0, 60)))).tolist()))
    far = lambda x, y: sum(((a ^ b) & simhash.MASK).bit_count() for a, b in zip(x, y))
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and far(a[2], b[2]) <= 60]
    groups = {r[1] for r in rows}
    for cut in (1, 3, 7, 50, 1000):
        batches = [
            simhash.pa.RecordBatch.from_arrays([simhash.pa.array([r[i] for r in rows[a : a + cut]], kind) for i, kind in enumerate((simhash.pa.int64(), simhash.pa.int64(), simhash.pa.list_(simhash.pa.int64())))], ["key", "component", "fp"])
            for a in range(0, len(rows), cut)
        ]
        links = [(r["a"], r["b"]) for b in simhash._small_links(60, 8)(batches) for r in b.to_pylist()]
        assert _groups(links, groups) == _groups(pairs, groups)


def test_small_keys_make_no_pairs(spark, monkeypatch):
    """Texts of small keys are compared in their order and not joined with each other."""
    plans = []

    def components(edges, *_):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        if len(plans) > 1:
            raise StopIteration
        return spark.createDataFrame([], "node long, component long")

    monkeypatch.setattr(simhash, "connected_components", components)
    monkeypatch.setattr(simhash, "confirmed", lambda *_: spark.createDataFrame([], "a long, b long"))
    draw = np.random.default_rng(5)
    texts = spark.createDataFrame([(i, draw.integers(-(2**63), 2**63, 24).tolist()) for i in range(6)] * 2, "id long, fp array<bigint>")
    with pytest.raises(StopIteration):
        simhash.close_texts(texts.withColumn("id", F.monotonically_increasing_id()), None, 5, 0.8, 24, 330, 8, 1024)
    assert "Join" in plans[1] and not re.search(r"\w+#\d+L? < \w+#\d+L?", plans[1])


def test_grid_joins_only_keys_of_several_parts(spark):
    """A key of one part is one cell without a join; the parts of a larger one meet in pairs, but not inside a group."""
    rows = [("a", i, i, i, 2) for i in range(2)] + [("b", 10 + i, i, 10 if i < 4 else 10 + i, 5) for i in range(5)]
    grid = simhash._grid(spark.createDataFrame(rows, "key string, id long, pos long, component long, total long"), 2, "key")
    cells = sorted((r["key"], r["i"], r["j"], r["id"]) for r in grid.collect())
    assert cells == [("a", 0, 0, 0), ("a", 0, 0, 1)] + [("b", i, 2, 10 + k) for i in range(2) for k in (2 * i, 2 * i + 1, 4)]
    plan = grid._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().apply(0).toString()


def test_families_of_one_part_meet_no_grid(spark, monkeypatch):
    """Families are confirmed by parts first, and those of one part are done then."""
    draw = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(120)]
        for at in draw.sample(range(120), draw.choice([2, 3, 4])):
            words[at] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sent, grid = [], simhash._grid

    def recorded(placed, *args):
        sent.append(placed.count())
        return grid(placed, *args)

    monkeypatch.setattr(simhash, "_grid", recorded)
    assert simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() > 1
    assert sent[-1] == 0
