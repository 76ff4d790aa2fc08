"""Every registered query against its SQL on the smallest tables."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORPUS = re.compile(r"op\d+_|pipeline$")  # these have tests of their own
QUERIES = {name: query for name, query in entry.queries().items() if not CORPUS.match(name)}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if not CORPUS.match(name)}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def _check_plan(df):
    """No cross join, no window over a whole table, no Python row by row."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    for spec in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", text):
        assert not re.match(r"\S+ (ASC|DESC)", spec), "window without partition"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    _check_plan(df)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = Counter(tuple(_plain(row[i]) for i in places) for row in result.fetchall())
    assert got == expected and got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 50 and df.columns == ["gene", "n_altered", "n_blank", "n_samples", "pct_altered"]
