"""Every registered query against its SQL, and the shape of its plan."""

import glob
import math
import os
import re

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = _sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in ORACLES:
        assert found
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(columns) == names
    wanted = _sorted(tuple(_plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert found == wanted
    for field in df.schema.fields:
        assert TYPES[field.dataType.simpleString()] == kinds[field.name]


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"]
    assert df.count() > 0


def test_every_query_but_listed_ones_has_sql():
    without = {q for q in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline$", q)}
    assert not without  # those of the training-data operators have tests of their own


def test_ranked_search_limits_before_the_shuffle(spark):
    plan = QUERIES["bm25_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["top_companies"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan
