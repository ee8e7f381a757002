"""An index of all terms: one shuffle of the counts, and what a row counts by itself."""

import random
from collections import Counter

from pyspark.sql import functions as F

from recollect.functions import scores, text
from recollect.operators import lexical


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_postings_are_shuffled_once_and_not_sorted(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(50)], "id long, text string")
    plan = plan_of(lexical.build_index(docs).postings)
    assert "SortMergeJoin" not in plan
    dealt = [line for line in plan.splitlines() if " Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
    assert len(dealt) == 1 and plan.count("ReusedExchange") == 2


def test_counts_of_a_text_are_those_of_its_tokens(spark):
    texts = ["The cache cache leak", "the of", "Été-café OK2go", None, "", "Kelvin İx \x00a\x00 A a", "is 1 1 01 über_x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokens("t").alias("tokens")).collect()
    for r in rows:
        assert text.token_counts(None if r["t"] is None else r["t"].encode()) == Counter(r["tokens"])


def test_rows_of_one_id_and_length_are_counted_together(spark):
    rows = [(1, "ant ant bee"), (1, "ant cow the dog"), (1, "ant"), (None, "ant"), (2, None), (2, ""), (3, "the")]
    docs = spark.createDataFrame(rows, "id long, text string")
    want, lengths = Counter(), Counter()
    for id_, t in rows:
        words = [w for w in (t or "").split() if w != "the"]
        lengths[id_, len(words)] += 1
        for w in words:
            want[id_, len(words), w] += 1
    index = lexical.build_index(docs)
    assert {(r["id"], r["length"], r["term"]): r["n"] for r in lexical.term_counts(docs).collect()} == want
    assert {(r["id"], r["length"], r["term"]): round(r["tf"] * r["length"]) for r in index.postings.collect()} == want
    assert sorted((r["id"] or 0, r["length"]) for r in index.lengths.collect()) == sorted((i or 0, n) for i, n in lengths)
    corpus = index.corpus.first()
    assert (corpus["n"], corpus["mean_length"]) == (7, 8 / 7)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == Counter(t for _, _, t in want)


def test_parts_have_statistics_of_their_own(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, i % 3, " ".join(r.choices("abcdefgh", k=r.randint(0, 6)))) for i in range(40)], "id long, part long, text string")
    found = lexical.build_index(docs, ["part"])
    for part in range(3):
        own = lexical.build_index(docs.where(F.col("part") == part).drop("part"))
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(found.postings.where(F.col("part") == part).drop("part")) == rows(own.postings)
        assert rows(found.terms.where(F.col("part") == part).drop("part")) == rows(own.terms)
        assert rows(found.corpus.where(F.col("part") == part).drop("part")) == rows(own.corpus)


def test_rounded_as_round(spark):
    r = random.Random(7)
    values = [0.0, -0.0, 0.5, 1e-9, -1e-9, 4.9e-9, 5e-9, 5.1e-9, 0.123456785, 0.123456775, 1.000000005, -0.123456785, 999.999999995, 1000.000000005, 123456.123456785, 1e15 + 0.3, 1e300, -1e300]
    values += [r.uniform(-20, 20) for _ in range(3000)] + [(2 * r.randrange(10**9) + 1) / 2e8 for _ in range(3000)] + [r.random() * 10 ** r.randint(-12, 6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    assert df.where(~F.round("x", 8).eqNullSafe(scores.rounded(F.col("x")))).collect() == []
    special = spark.sql("select double('NaN') x union all select double('-Infinity') union all select double('Infinity')").select(scores.rounded(F.col("x")).alias("y"))
    assert sorted(map(str, (r["y"] for r in special.collect()))) == ["-inf", "inf", "nan"]
