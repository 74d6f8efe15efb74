"""Every query of the catalogue against DuckDB, on the driver's tables."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(None if r[i] is None or isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = plain(cursor.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)
