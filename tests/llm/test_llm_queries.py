"""Queries of the subpackage against SQL on the smallest tables; what SQL can't express against brute force elsewhere."""

import duckdb
import pytest

from recollect.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = c.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == sorted((tuple(r[names.index(x)] for x in columns) for r in result.fetchall()), key=key)


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
