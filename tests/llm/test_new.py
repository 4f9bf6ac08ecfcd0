"""Merkle manifest, collocations and mixing against brute force on small and difficult tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from rows_llm import documents, empty, nasty  # noqa: F401

from paperloom.llm import collocations, merkle, mixture
from paperloom.operators import numbering

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------------------------


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, index):
    """Root of a list of digests and the siblings of one of them, as (left, right) per level."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        run, slot = runs[index // 3], index % 3
        path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, index = [sha("".join(r)) for r in runs], index // 3
    return nodes[0], path


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows of COLUMNS."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: r[:3])
    subroots = [climb([r[2] for r in groups[s]], 0)[0] for s in names]
    found = []
    for number, s in enumerate(names):
        for place, (_, _, leaf, row) in enumerate(groups[s]):
            _, low = climb([r[2] for r in groups[s]], place)
            root, high = climb(subroots, number)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(*row[:4], text)
            for left, right in low + high:
                node = sha(left + node + right)
            found.append((row[0], leaf, subroots[number], root, sha("".join(a + b for a, b in low + high)), node, node == root))
    return sorted(found, key=repr)


def manifest_of(df):
    struck = merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 2 == 0
    claimed = merkle.F.when(struck, merkle.F.translate("text", "\n", "")).otherwise(merkle.F.col("text"))
    return sorted((tuple(r) for r in merkle.verified(df.withColumn("claimed", claimed)).collect()), key=repr)


@pytest.mark.parametrize("levels", [2, 7])
def test_manifest_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", 3**levels)
    draw = random.Random(5)
    sizes = {"hot": 100, None: 1, "": 9, "é": 28, "Z": 3, "a": 4, **{f"s{i}": 1 + i % 3 for i in range(8)}}
    rows = [(1000 * k + draw.randrange(500), s, draw.choice(["en", None]), i, draw.choice(["one\ntwo", "", None, "x" * 50])) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "hot", None, None, None), (7, "hot", "en", 1, "same\n"), (7, "hot", "en", 1, "same\n")]
    assert manifest_of(spark.createDataFrame(rows, COLUMNS)) == brute_manifest(rows)


def test_manifest_of_difficult_rows(spark, nasty, empty):
    rows = [tuple(r) for r in nasty.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_of(nasty) == brute_manifest(rows)
    assert merkle.verified(empty.withColumn("claimed", merkle.F.col("text"))).count() == 0
    lone = [(5, "s", "en", 3, "abc")]
    assert manifest_of(spark.createDataFrame(lone, COLUMNS)) == brute_manifest(lone)


def test_manifest_without_broadcasts(spark, monkeypatch, documents):
    wanted = manifest_of(documents)
    monkeypatch.setattr(numbering, "fits_broadcast", lambda df: False)
    assert manifest_of(documents) == wanted
    assert wanted == brute_manifest([tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()])


# --- collocations ------------------------------------------------------------------------------


def brute_collocations(rows, least, cover=50, top=2000):
    """Sorted rows of the query from (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            score, k = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            if len(words) == 2 and any(x[0] == lang and len(x[1]) == 3 and words in (x[1][:2], x[1][1:]) and c >= least and 100 * c >= cover * a for x, c in f.items()):
                continue
            found[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    rows = []
    for lang, own in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):  # noqa: E741
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def mined(rows, spark, **options):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), **options).collect())


@pytest.mark.parametrize("block", [1, 7, 50, 100000])
def test_collocations_against_brute_force(spark, block):
    draw = random.Random(2)
    words = ["a", "B", "c", "dd", "é", "漢", "x", "y"]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".\n"]) for _ in range(draw.randrange(40)))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [("en", f"{draw.choice(words)} {passage} {draw.choice(words)}") for _ in range(6)] + [("en", None), ("en", ""), ("fr", " . \n")]
    if block == 1:
        rows = rows[:12]
    assert mined(rows, spark, least=3, block=block) == brute_collocations(rows, 3)


def test_collocations_of_common_pairs_and_long_texts(spark, monkeypatch):
    """A pair with very many followers is dealt out and comes back whole; salted lookups give the same."""
    rows = [("en", " ".join(f"of the w{(i * 7 + j) % 90}" for j in range(60))) for i in range(30)]
    rows += [("en", "over and over again " * 3000), ("en", "of the end"), ("de", "of the w1")]
    wanted = brute_collocations(rows, 5)
    seen = collocations.graph(spark.createDataFrame(rows, "lang string, text string"), least=5, block=500)[1]
    assert seen.where("node = 'of the' AND lang = 'en'").first()["flow"] == 30 * 60 + 1
    assert mined(rows, spark, least=5, block=500) == wanted
    monkeypatch.setattr(collocations, "fits_broadcast", lambda df: False)
    assert mined(rows, spark, least=5, block=500, top=3) == brute_collocations(rows, 5, top=3)


def test_paths_are_compact(spark):
    """A passage that always occurs whole is one path, and its inner nodes take their counts from it."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [("en", f"{passage}. some other {i} words") for i in range(5)]
    edges, nodes = collocations.graph(spark.createDataFrame(rows, "lang string, text string"), least=5)
    found = [r["words"] for r in collocations.paths(edges, nodes).collect()]
    assert sorted(map(len, found)) == [40] and found[0] == passage.split()


def test_collocations_of_difficult_rows(spark, nasty, empty):
    rows = [(r["lang"], r["text"]) for r in nasty.collect()]
    assert mined(rows, spark, least=10) == brute_collocations(rows, 10)
    assert sorted(tuple(r) for r in collocations.collocations(nasty).collect()) == brute_collocations(rows, 10)
    assert collocations.collocations(empty).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Targets of sources (name or None to size) by resharing in exact fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        level = Fraction(left) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def check_mix(rows, found):
    size = Counter()
    for _, s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken, largest = brute_targets(size), Counter(), Counter()
    by_id = {r["doc_id"]: r for r in found}
    for i, s, t in rows:
        r = by_id[i]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r["source_size"] == size[s]
        assert abs(r["target"] - float(target[s])) <= 1e-6 * (1 + r["target"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - float(target[s])) <= largest[s] / 2 + 1e-6


def test_mix_meets_the_targets(spark, monkeypatch):
    draw = random.Random(4)
    names = ["a", "b", "B", "é", "", None, "zz", "q"]
    rows = [(i, "hot" if i % 3 == 0 else draw.choice(names), " ".join("w" * draw.randrange(60))) for i in range(900)]
    rows += [(1000, "tiny", "one"), (1001, "blank", " \t\n"), (1002, "none", None), (1003, "huge", "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixture.mix(df).collect()
    check_mix(rows, found)
    assert sorted(found) == sorted(mixture.mix(df.repartition(7)).collect())  # reruns agree
    monkeypatch.setattr(mixture, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(numbering, "fits_broadcast", lambda df: False)
    assert sorted(found) == sorted(mixture.mix(df).collect())


def test_larger_mixes_hold_smaller_ones(spark):
    rows = [(i, "s", "w " * (1 + i % 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    few, many = ({r["doc_id"] for r in mixture.mix(df, share=share).collect() if r["taken"]} for share in (0.3, 0.6))
    assert few < many


def test_mix_of_difficult_rows(nasty, empty):
    found = mixture.mix(nasty).collect()
    assert len(found) == nasty.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert sum(r["taken"] for r in found) <= 2 * found[0]["source_size"]
    assert mixture.mix(empty).count() == 0


def test_words_of_sliced_batches():
    """Batches that are slices of larger ones give the same words."""
    table = collocations.pa.table({"text": ["Aa bb. Cc", "dé E,ff", "x Y", None, "Gg. h"], "lang": ["en"] * 5})
    whole = [w for w in collocations._words(table.to_batches()[0])[0].to_pylist()]
    parts = [w for at in range(5) for w in collocations._words(table.slice(at, 1).to_batches()[0])[0].to_pylist()]
    assert whole == parts == ["aa", "bb", "cc", "dé", "e", "ff", "x", "y", "gg", "h"]
