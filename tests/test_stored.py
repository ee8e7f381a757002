"""Searches that leave parts unread: stored blocks, stored buckets, cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import blocks, lexical, temporal
from recollect.sources import tables


def rows_of(found, *columns):
    return sorted(tuple(x[c] for c in columns) for x in found.collect())


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], [0, 255, 256, 70_000], [-4, 2**40, 2**62]])
def test_gaps(ids):
    a = np.array(ids, np.int64)
    assert blocks.decode(ids[0], blocks.encode(a)).tolist() == ids


def test_gaps_of_many_runs_at_once():
    r = random.Random(6)
    for _ in range(100):
        runs = [sorted(r.sample(range(-(2 ** (1 + r.randrange(62))), 2 ** r.randrange(7, 63)), r.choice([1, 1, 2, 9]))) for _ in range(r.randint(1, 12))]
        ends = np.cumsum([len(x) for x in runs])
        starts = ends - [len(x) for x in runs]
        skipped = r.randrange(len(runs))
        found = blocks.encode_all(np.array([i for x in runs for i in x], np.int64), starts[skipped:], ends[skipped:]).to_pylist()
        assert found == [blocks.encode(np.array(x, np.int64)) for x in runs[skipped:]]


@pytest.fixture(scope="module")
def texts(spark):
    from conftest import DATA

    sf = f"{DATA}/sf0.01"
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@pytest.mark.parametrize("block,shard_documents,classes,k,partitions,share", [(64, 65_536, 256, 10, 4, 1.0), (16, 65_536, 50, 10, 4, 0.9), (8, 100, 400, 10, 7, 1.0), (1, 333, 50, 1, 2, 0.8), (16, 5_000, 99, 100, 4, 1.0)])
def test_pruned_search_is_exact_and_skips(spark, texts, tmp_path, block, shard_documents, classes, k, partitions, share):
    docs, asked = texts
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    stored = blocks.store_index(docs, str(tmp_path / "i"), block=block, shard_documents=shard_documents, class_documents=classes)
    short = asked.union(spark.createDataFrame([(9_000 + n, t) for n, t in enumerate(["", "absent", "data", "the data of data"])], "query_id long, text string"))
    want = rows_of(lexical.search(short, docs, k), "query_id", "id", "score", "rank")
    assert rows_of(stored.search(short, k), "query_id", "id", "score", "rank") == want
    work = stored.work(short, k).agg(F.sum("postings").alias("postings"), F.sum("decoded").alias("decoded")).first()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < work["decoded"] <= share * work["postings"]


def test_best_against_all_scores():
    r = random.Random(4)
    for _ in range(200):
        weights = {t: {d: r.choice([0.1, 1.0, r.random()]) for d in r.sample(range(60), r.randint(1, 40))} for t in range(r.randint(1, 6))}
        times = {t: r.randint(1, 3) for t in weights}
        size = r.randint(1, 9)
        terms = []
        for t, of in weights.items():
            ids = sorted(of)
            cuts = [ids[n : n + size] for n in range(0, len(ids), size)]
            terms.append((float(times[t]), blocks._Term([(c[0], c[-1], max(of[d] for d in c), blocks.encode(np.array(c)), np.array([of[d] for d in c]).tobytes()) for c in cuts])))
        scores = {}
        for t, of in weights.items():
            for d, w in of.items():
                scores[d] = scores.get(d, 0) + times[t] * w
        k = r.randint(1, 8)
        want = sorted(((round(s, 8), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        least = want[-1][0] if len(want) == k and r.random() < 0.5 else 0.0
        ids, found, _ = blocks.best(terms, k, least)
        got = sorted(((round(s, 8), d) for d, s in zip(ids.tolist(), found.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
        assert [d for _, d in got] == [d for _, d in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_one_term_reads_one_slice(spark, texts, tmp_path):
    docs, _ = texts
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = blocks.store_index(docs, str(tmp_path / "i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = lexical.build_index(docs)
    folders = {f.rsplit("/", 2)[1] for f in stored.blocks.inputFiles()}
    assert len(folders) > 2
    for term in [r["term"] for r in index.terms.orderBy(F.desc("df"), "term").limit(3).collect()] + ["no such term"]:
        found = stored.postings(term)
        read = {f.rsplit("/", 2)[1] for f in found.inputFiles()} if found.head(1) else set()
        assert len(read) <= 2
        want = rows_of(index.postings.where(F.col("term") == term).select("id", F.round("weight", 8).alias("w")), "id", "w")
        assert rows_of(found.select("id", F.round("weight", 8).alias("w")), "id", "w") == want
    assert rows_of(stored.offsets(), "term", "term_id", "df", "first") == rows_of(lexical.csr(index), "term", "term_id", "df", "first")


def test_empty_index(spark, tmp_path):
    stored = blocks.store_index(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert stored.search(asked, 5).collect() == [] and stored.postings("x").collect() == [] and stored.offsets().collect() == []


@pytest.mark.parametrize("threshold", [0.0, 0.7, 2.0])
def test_stored_buckets_are_read_as_far_as_needed(spark, tmp_path, threshold):
    r = random.Random(2)
    words = ["ant", "bee", "cat", "dog", "elk", "fox"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 6))), 1000 * r.randrange(9)) for i in range(120)]
    records = temporal.bucketed(spark.createDataFrame(rows, "id long, text string, ts_ms long"), 1500)
    asked = spark.createDataFrame([(q, " ".join(r.choices(words, k=2))) for q in range(12)] + [(99, "absent")], "query_id long, text string")
    k = 4
    temporal.store_by_bucket(records, str(tmp_path / "t"))
    found = temporal.search_stored(spark, asked, str(tmp_path / "t"), str(tmp_path / "w"), k, threshold=threshold)
    columns = ("query_id", "id", "score", "rank", "stop")
    assert rows_of(found.results(), *columns) == rows_of(temporal.search_early_stop(asked, records, k, threshold=threshold), *columns)
    assert rows_of(found.stats(120), "query_id", "partitions_searched", "records_searched", "search_fraction") == rows_of(temporal.search_stats(asked, records, k, threshold=threshold), "query_id", "partitions_searched", "records_searched", "search_fraction")


def test_buckets_that_nobody_asks_for_stay_closed(spark, tmp_path):
    """A bucket's folder can be gone once no query needs it."""
    rows = [(i, "ant bee", 1000 * (i % 5)) for i in range(50)]
    records = temporal.bucketed(spark.createDataFrame(rows, "id long, text string, ts_ms long"), 1000)
    temporal.store_by_bucket(records, str(tmp_path / "t"))
    asked = spark.createDataFrame([(1, "ant"), (2, "bee")], "query_id long, text string")
    for bucket in (0, 1, 2, 3):  # unreadable from here on
        for f in (tmp_path / "t" / f"bucket={bucket}").glob("*.parquet"):
            data = f.read_bytes()
            f.write_bytes(b"PAR1" + b"\0" * 40 + data[44:])  # the footer stays, the columns are destroyed
    found = temporal.search_stored(spark, asked, str(tmp_path / "t"), str(tmp_path / "w"), 3, threshold=0.5)
    assert rows_of(found.asked, "query_id", "po") == [(1, 1), (2, 1)]
    assert {x[0] for x in rows_of(found.results(), "query_id")} == {1, 2}
