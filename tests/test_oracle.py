"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from searchloom import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = _norm(df.select(*[f"`{c}`" for c in cols]).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == _norm(tuple(r[i] for i in order) for r in res.fetchall())


def test_only_rows_without_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"vector_probed"}  # approximate; test_vectors has its recall
