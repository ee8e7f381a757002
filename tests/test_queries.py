"""Every registered query of the library against SQL on the smallest tables."""

import duckdb
import pytest

from recollect.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return str([normal(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    from conftest import DATA

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if name not in oracles.SQL:
        assert rows
        return
    result = duck.execute(oracles.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_every_sql_has_its_query():
    assert set(oracles.SQL) <= set(queries.QUERIES)
