"""Queries against their SQL on tables with nulls, repeated rows and ids, empty and very long texts."""

import random

import duckdb
import pytest

from recollect.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, top):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(words, k=130))
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(30)] + [None, "", "é", passage, f"{passage} {passage}", "x" * 5_000, "ab" * 700, " ".join(words) * 8]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "en", "de"]), r.choice([None, "web"]), r.choice([None, 5])) for _ in range(90)]
    rows += [(k, f"{r.choice(texts)} {passage}", "en", "web", 1) for k in range(50, 70)]
    rows += rows[::3]  # whole rows again
    items = [(None, passage), (1, " ".join(words[:9])), (1, " ".join(words[:30])), (2, None), (3, ""), (None, "w1 w2"), (4, texts[0])]
    items += items[:2]
    turns = [(r.choice([None, *range(25)]), r.choice([None, 0, 1, 2]), r.choice([None, "user"]), r.choice([None, "", "hi", "x" * 20_000])) for _ in range(200)]
    for name, own, schema in (("documents", rows, DOCUMENTS), ("benchmark", items, "item_id long, text string"), ("conversations", turns, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(own, schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{top}/empty/{name}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"))


def both(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = c.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    key = lambda row: tuple(map(str, row))
    return sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key), sorted((tuple(r[names.index(x)] for x in columns) for r in result.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op4_window_dedup", "op5_suffix_dedup", "op8_decontaminate", "op11_merkle", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, odd, name):
    found, want = both(spark, odd, name)
    assert found == want and found
    found, want = both(spark, f"{odd}/empty", name)
    assert found == want == []
