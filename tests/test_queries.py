"""Every registered query that has SQL gives the same rows in Spark and DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int | float) or hasattr(value, "as_tuple"):
        return float(f"{float(value):.8g}")
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    out = catalog.queries()[name](spark, FOLDER)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(out.columns) == sorted(names)
    mine, theirs = rows(out.columns, out.collect()), rows(names, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
