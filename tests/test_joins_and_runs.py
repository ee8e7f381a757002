"""Filters as a join, runs of values, consolidation over several runs, approximate neighbours: against plain loops."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import cells, dense, fusion, runs, tiers
from recollect.sources import tables

ASKED = "query_id long, session_filter string, agent_filter long, role_filter string, time_start long, time_end long"
HELD = "id long, session_id string, agent_id long, role string, ts_ms long"


@pytest.mark.parametrize("bins", [1, 7, 64])
def test_matches_against_all_pairs(spark, bins):
    r = random.Random(bins)
    maybe = lambda x: r.choice([None, x])
    asked = [(q, maybe(f"s{r.randrange(5)}"), maybe(r.randrange(3)), maybe(r.choice("ab")), maybe(r.randrange(100)), maybe(r.randrange(100))) for q in range(60)]
    held = [(i, maybe(f"s{r.randrange(5)}") if i % 9 == 0 else f"s{r.randrange(5)}", r.randrange(3), r.choice("ab"), None if i % 31 == 0 else r.choice([50, r.randrange(100)])) for i in range(300)]
    ok = lambda f, x: f is None or f == x
    want = sorted((q, i) for q, s, a, o, lo, hi in asked for i, s2, a2, o2, t in held if ok(s, s2) and ok(a, a2) and ok(o, o2) and (lo is None or (t is not None and t >= lo)) and (hi is None or (t is not None and t <= hi)))
    found = fusion.matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD), bins)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert fusion.matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame([], HELD)).collect() == []


@pytest.mark.parametrize("n,values,partitions", [(0, 1, 3), (1, 1, 3), (400, 2, 9), (400, 1, 9), (300, 50, 4)])
def test_runs_against_groupby(spark, tmp_path, n, values, partitions):
    r = random.Random(n + values)
    rows = [(k * 3, r.choice([None, *range(values)]) if values > 1 else 7) for k in range(n)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = runs.runs(spark.createDataFrame(rows, "at long, v long"), ["at"], "v", str(tmp_path / "r")).orderBy("run").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for value, own in groupby(sorted(rows), key=lambda x: x[1]):
        own = list(own)
        want.append((len(want), value, own[0][0], own[-1][0], len(own)))
    assert [(x["run"], x["value"], x["first"]["at"], x["last"]["at"], x["n"]) for x in found] == want


def test_consolidation_over_runs_against_a_loop(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"c{r.randrange(9)}", "w " * r.randint(1, 4), [r.random() for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, cluster string, content string, embedding array<double>")
    bounds = [0, 25, 26, 60]
    state, entries = None, []
    for run, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        state, own = tiers.store_run(frame.where(F.col("id").between(lo, hi - 1)), state, str(tmp_path / "c"), run)
        entries.append(own)
    found = tiers.appended_entries(*entries).orderBy("entry").collect()
    want = []
    for run, hi in enumerate(bounds[1:]):
        clusters = {}
        for row in rows[:hi]:
            clusters.setdefault(row[1], []).append(row)
        for own in sorted((c for c in clusters.values() if len(c) >= 2), key=lambda c: c[0][0]):
            best = max(own, key=lambda x: (len(x[2]), -x[0]))
            v = np.sum([x[3] for x in own], axis=0)
            want.append((len(want), run, own[0][1], [x[0] for x in own], min(1.0, len(own) / 5), best[2], (v / np.linalg.norm(v)).round(9).tolist()))
    assert [(x["entry"], x["run"], x["cluster"], x["source_ids"], x["confidence"], x["content"], np.round(x["embedding"], 9).tolist()) for x in found] == want


def recalls(spark, found, exact):
    near = {}
    for x in exact.collect():
        near.setdefault(x["query_id"], set()).add(x["id"])
    got = {}
    for x in found.collect():
        got.setdefault(x["query_id"], set()).add(x["id"])
    return [len(got.get(q, set()) & ids) / len(ids) for q, ids in near.items()]


def test_neighbours_from_cells(spark, tmp_path):
    """On vectors without any structure only the codes can prune; recall and work at several knob settings."""
    vectors = tables.table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    n = vectors.count()
    exact = dense.knn(asked, vectors, 10)
    index = cells.store_cells(vectors, str(tmp_path / "i"), list_rows=300)
    assert sorted(r["id"] for r in index.stored.select("id").collect()) == sorted(r["id"] for r in vectors.select("id").collect())
    settings = [(16, 0.1), (16, 0.05), (5, 0.1), (2, 0.1)]
    seen = []
    for probes, compared in settings:
        found = recalls(spark, index.search(asked, 10, probes=probes, compared=compared), exact)
        work = index.work(asked, 10, probes=probes, compared=compared).agg(F.sum("coded"), F.sum("compared")).first()
        seen.append((sum(found) / len(found), min(found), work[0] / (n * len(found)), work[1] / (n * len(found))))
    print("\nmean recall, least recall, coded, compared:", seen)
    assert seen[0][1] >= 0.9 and seen[0][3] < 0.12  # every query
    assert seen[1][0] >= 0.95 and seen[1][3] < 0.07
    assert seen[2][2] < 0.75 and seen[3][2] < seen[2][2] and seen[3][0] < seen[2][0] < seen[0][0]  # fewer cells, less work, less found


def test_neighbours_from_many_cells(spark, tmp_path):
    """The default finds nine of ten for every query however many cells there are; a fixed number of probes doesn't."""
    vectors = tables.table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    exact = dense.knn(asked, vectors, 10)
    index = cells.store_cells(vectors, str(tmp_path / "i"), cells=40)
    assert min(recalls(spark, index.search(asked, 10), exact)) >= 0.9
    assert min(recalls(spark, index.search(asked, 10, probes=16), exact)) < 0.9
    assert index.work(asked, 10).agg(F.max("compared")).first()[0] < 0.2 * vectors.count()


def test_cells_prune_where_vectors_cluster(spark, tmp_path):
    r = np.random.Generator(np.random.PCG64(3))
    middles = r.normal(size=(16, 32))
    rows = [(k, (middles[k % 16] + 0.2 * r.normal(size=32)).tolist()) for k in range(1600)] + [(5_000, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id % 40 = 0 and embedding is not null").withColumnRenamed("id", "query_id")
    index = cells.store_cells(vectors, str(tmp_path / "i"))
    found = recalls(spark, index.search(asked, 10, probes=2, compared=0.5), dense.knn(asked, vectors, 10))
    work = index.work(asked, 10, probes=2, compared=0.5).agg(F.sum("coded"), F.sum("compared")).first()
    assert min(found) >= 0.9 and work[0] < 0.3 * 1600 * len(found) and work[1] < 0.15 * 1600 * len(found)


def test_cells_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    index = cells.store_cells(empty, str(tmp_path / "i"))
    assert index.search(empty.withColumnRenamed("id", "query_id"), 5).collect() == []


def test_neighbours_by_a_grid_equal_brute_force(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(8))
    points = r.integers(-3, 4, size=(120, 4)).astype(float)  # many ties
    points[60:70] = points[0]
    rows = [(k, v.tolist()) for k, v in enumerate(points)] + [(900, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = vectors.where("id % 3 = 0").select((F.col("id") + 1000).alias("query_id"), "embedding")
    want = []
    for q in range(0, 120, 3):
        d2 = ((points - points[q]) ** 2).sum(1)
        want += [(q + 1000, i, n + 1) for n, i in enumerate(sorted(range(120), key=lambda i: (d2[i], i))[:7])]
    for block, queries, held in ((2_048, 8_192, 32_768), (10, 8_192, 32_768), (10, 9, 17), (39, 1, 500), (40, 1, 1)):
        for name, value in (("QUERY_BLOCK", block), ("GRID_QUERIES", queries), ("GRID_VECTORS", held)):
            monkeypatch.setattr(dense, name, value)
        assert sorted((x["query_id"], x["id"], x["rank"]) for x in dense.knn(asked, vectors, 7).collect()) == sorted(want)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 0)
    assert dense.knn(asked, vectors.where("false"), 7).collect() == []
    assert dense.knn(asked.where("false"), vectors, 7).collect() == []


def test_queries_of_a_cell_in_blocks(spark, tmp_path, monkeypatch):
    """All queries ask one cell; dealt into blocks they find the same and do the same work."""
    r = np.random.Generator(np.random.PCG64(4))
    rows = [(k, (r.normal(size=16) + (8 if k % 3 else -8)).tolist()) for k in range(300)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    index = cells.store_cells(vectors, str(tmp_path / "i"), cells=2, list_rows=40)
    ask = lambda: (sorted(map(tuple, index.search(asked, 5, probes=1).collect())), sorted(map(tuple, index.work(asked, 5, probes=1).collect())))
    once = ask()
    monkeypatch.setattr(cells, "ASKED_ROWS", 7)
    assert ask() == once and len(once[0]) == 500 and {w[1] for w in once[1]} == {100}
