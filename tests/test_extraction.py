"""Extractions compared with their truth, against plain loops over all pairs of tables."""

import random
import time

from pyspark.sql import functions as F

from paperloom.operators import evaluation as E
from paperloom.session import write_through

TABLES = "array<array<string>>"


def share(seen, wanted, limit=0.8):
    """Share of wanted tables with a seen one alike, every pair looked at."""
    if not wanted:
        return 0.0 if seen else 1.0

    def alike(a, b):
        union = len(set(a) | set(b)) if a is not None and b is not None else 0
        return union > 0 and len(set(a) & set(b)) / union > limit

    return sum(any(alike(a, b) for a in seen or []) for b in wanted) / len(wanted)


def test_recall_as_by_all_pairs(spark):
    draw = random.Random(5)

    def table():
        return draw.choice([None, [], [None], *[[draw.choice(["x", "y", "é", "", None])] * 2 for _ in range(2)], *[[f"w{i}" for i in draw.sample(range(14), draw.randrange(1, 13))] for _ in range(12)]])

    rows = [(i, [table() for _ in range(draw.randrange(9))], [table() for _ in range(draw.randrange(9))]) for i in range(400)]
    rows += [(1000, None, [["a"]]), (1001, [["a"]], None), (1002, None, None), (1003, [["b", "a"]], [["a", "b"], ["a", "b", "a"]])]
    rows += [(2000 + i, t, t) for i, t in enumerate(([], [[]], [None], [["a"], None, []], [[None]], [["a", "b"], ["a"]]))]
    data = spark.createDataFrame(rows, f"id int, seen {TABLES}, wanted {TABLES}").repartition(3)
    found = {r["id"]: r["recall"] for r in data.select("id", E.table_recall(F.col("seen"), F.col("wanted")).alias("recall")).collect()}
    assert found == {i: share(seen, wanted) for i, seen, wanted in rows}
    assert 0 < sum(0 < x < 1 for x in found.values())


def test_tables_of_a_document_are_not_all_compared(spark):
    """4,000 tables without an equal on either side: 16 million pairs, a few of which share one of their rare cells."""
    tables = lambda k: [[f"{c}c{n + k if c < 7 else 0}" for c in range(24)] for n in range(4000)]
    data = spark.createDataFrame([(tables(100_000), tables(0))], f"seen {TABLES}, wanted {TABLES}")
    recall = E.table_recall(F.col("seen"), F.col("wanted")).alias("none"), E.table_recall(F.reverse("wanted"), F.col("wanted")).alias("all")
    data.select(F.slice("seen", 1, 2).alias("seen"), F.slice("wanted", 1, 2).alias("wanted")).select(*recall).collect()  # workers are there
    begun = time.time()
    found = data.select(*recall).first()
    assert (found["none"], found["all"]) == (0.0, 1.0)
    assert time.time() - begun < 15


def test_repeated_and_missing_keys(spark):
    """All pairs of rows of a key count once for each row of the truth, a key that an extraction lacks with empty sets."""
    kind = f"doc_id int, words array<string>, tables {TABLES}"
    truth = [(1, ["a", "b"], [["a"], ["b"]]), (1, ["a"], [["a"]]), (2, ["c"], [["c"]]), (None, ["d"], [["d"]]), (3, None, None), (4, [], []), (5, ["e"], [])]
    read = [(1, ["a"], [["a"]]), (1, None, None), (2, ["c", "x"], [["x"]]), (2, ["c"], [["c"]]), (2, [], []), (None, ["d"], [["d"]]), (9, ["z"], []), (3, ["y"], [["y"]])]
    expected = []
    for key, words, tables in truth:
        times = sum(k == key for k, *_ in truth) if key is not None else 0
        for _, got, own in [r for r in read if r[0] == key] or [(key, None, None)]:
            got, known = set(got or []), set(words or [])
            p, r = (len(got & known) / len(got) if got and known else 0), (len(got & known) / len(known) if known else 0)
            expected += [(p, r, 2 * p * r / (p + r) if p + r else 0, share(own or [], tables))] * times
    found = E.compare_extractions({"one": spark.createDataFrame(read, kind), "none": spark.createDataFrame([], kind)}, spark.createDataFrame(truth, kind))
    by = {r["method"]: tuple(r)[1:] for r in found.collect()}
    assert by["one"] == (len(expected), *[round(sum(c) / len(expected), 6) for c in zip(*expected)])
    assert by["none"][:4] == (8, 0, 0, 0)


def test_passes_give_what_one_join_gives(spark, monkeypatch):
    """Large tables meet in passes over hashes of the key."""
    kind = f"doc_id int, words array<string>, tables {TABLES}"
    truth = [(i, [f"w{j}" for j in range(i % 7)], [[f"w{j}", "x"] for j in range(i % 5)]) for i in range(300)] + [(8, ["w1"], [["w1"]])]
    read = [(i, words[1:], tables[::2]) for i, words, tables in truth if i % 9]
    truth, read = [spark.createDataFrame(rows, kind) for rows in (truth, read)]
    once = E.compare_extractions({"one": read, "two": truth}, truth).collect()
    written, real = [], E.write_through
    monkeypatch.setattr(E, "write_through", lambda df, name: written.append(name) or real(df, name))
    assert sorted(E.compare_extractions({"one": read, "two": truth}, truth, pass_bytes=1, most=3).collect()) == sorted(once)
    assert len(once) == 2 and len(written) == 3


def test_written_tables_leave_no_shuffle_files(spark):
    statuses = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = statuses()
    assert write_through(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    assert statuses() <= before + 1  # that of the count
