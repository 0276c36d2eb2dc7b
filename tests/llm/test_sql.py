"""Every query of the subpackage that has SQL gives the same rows in Spark and DuckDB."""

from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    out = queries.QUERIES[name](spark, FOLDER)
    assert sorted(out.columns) == sorted(names)
    mine, theirs = sorted(tuple(r) for r in out.select(*names).collect()), sorted(found.fetchall())
    assert mine == theirs
