"""Each query that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_every_query_has_its_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
