"""The store, its index by segments, and streams with state, against loops and full builds."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from recollect.operators import lexical
from recollect.streaming import staging, store

WORDS = ["ant", "bee", "cat", "dog", "elk", "fox", "the", "of"]


def record(r, i):
    return (i, f"s{i % 7}", "a", "user", i, " ".join(r.choices(WORDS, k=r.randint(0, 9))), 0.5)


def batches(spark, n, size=40, seed=3):
    r = random.Random(seed)
    rows = [[record(r, b * size + i) for i in range(size)] for b in range(n)]
    return rows, [spark.createDataFrame(b, f"source_id long, {store.RECORD}") for b in rows]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "ant bee"), (2, "cat cat dog"), (3, "absent"), (4, "the")], "query_id long, text string")


def full(asked, rows):
    found = lexical.search(asked, rows.select(F.col("source_id").alias("id"), F.col("content").alias("text")), 10)
    return sorted(tuple(x[c] for c in ("query_id", "id", "score", "rank")) for x in found.collect())


def short(found):
    return sorted(tuple(x[c] for c in ("query_id", "id", "score", "rank")) for x in found.collect())


def test_segments_search_as_a_full_build(spark, asked, tmp_path):
    _, frames = batches(spark, 4)
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.search(asked, 10).collect() == [] and s.records().count() == 0
    seen = frames[0].limit(0)
    for n, frame in enumerate(frames):
        assert s.flush(frame, n) == n + 1
        seen = seen.union(frame)
        assert short(s.search(asked, 10)) == full(asked, seen)
    before = short(s.search(asked, 10))
    assert s.compact() == 5 and len(s.manifest()["segments"]) == 1
    assert short(s.search(asked, 10)) == before
    assert short(s.search(asked, 10, version=2)) == full(asked, frames[0].union(frames[1]))  # an earlier version stays
    read = s.search(asked, 10).inputFiles()
    assert read and all("/segments/compact-" in f for f in read)  # no texts
    assert s.compact() == 5


def test_a_flush_that_is_tried_again_counts_once(spark, tmp_path, monkeypatch):
    _, frames = batches(spark, 2)
    s = store.Store(spark, str(tmp_path / "s"))
    s.flush(frames[0], 0)

    def fails(self, rows):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_segment", fails)
        with pytest.raises(OSError):
            s.flush(frames[1], 1)  # the records were written, and nothing shows
    assert s.versions() == [1] and s.records().count() == 40
    assert s.flush(frames[1], 1) == 2
    assert s.flush(frames[1], 1) == 2
    assert s.records().count() == 80 and s.versions() == [1, 2]


def test_writers_publish_one_after_the_other(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.publish(lambda m: {**m, "flushes": [{"batch": -1, "records": "x", "n": 0, "tokens": 0}]})
    late = []

    def change(m):
        if not late:  # another writer is first
            late.append(1)
            s.publish(lambda o: {**o, "flushes": [*o["flushes"], {"batch": 7, "records": "y", "n": 0, "tokens": 0}]})
        return {**m, "flushes": [*m["flushes"], {"batch": 8, "records": "z", "n": 0, "tokens": 0}]}

    assert s.publish(change) == 3
    assert [f["batch"] for f in s.manifest()["flushes"]] == [-1, 7, 8]


def test_readers_beside_a_slow_flush_see_whole_versions(spark, tmp_path):
    rows, frames = batches(spark, 3)
    s = store.Store(spark, str(tmp_path / "s"))
    s.flush(frames[0], 0)

    @F.udf("string")
    def slow(text):
        time.sleep(0.02)
        return text

    def write():
        for n in (1, 2):
            s.flush(frames[n].repartition(4).withColumn("content", slow("content")), n)

    writer = threading.Thread(target=write)
    writer.start()
    seen = []
    while writer.is_alive():
        version = max(s.versions())
        found = s.records(version)
        ids = sorted(r["source_id"] for r in found.select("source_id").collect())
        assert ids == list(range(40 * version))
        seen.append(version)
    writer.join()
    assert seen[0] == 1 and len(seen) > 2 and s.records().count() == 120


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", staging.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, top, rows, schema, files, made):
    """Rows in files of their own, one file a batch -> what the stream writes."""
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{top}/in/{n:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(f"{top}/in/*")
    query = made(source).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/out").collect()


@pytest.mark.parametrize("files", [1, 50])
def test_staging_flushes_by_count(stateful, tmp_path, files):
    r = random.Random(files)
    rows = [[(100 * b + i, r.choice(["x", "y", "z"])) for i in range(r.randint(1, 90))] for b in range(5)]
    found = streamed(stateful, tmp_path, rows, "id long, kind string", files, lambda s: staging.flushes(s, key="kind", threshold=25))
    got = sorted((x["store"], x["flush"], x["id"]) for x in found)
    want, waiting, n = [], {}, {}
    for i, kind in (x for part in rows for x in part):
        waiting.setdefault(kind, []).append(i)
        if len(waiting[kind]) == 25:
            n[kind] = n.get(kind, 0) + 1
            want += [(kind, n[kind], j) for j in waiting.pop(kind)]
    if files > 1:
        assert got == sorted(want)
    else:  # files may come in another order
        assert len(got) == len(want) and {(k, f) for k, f, _ in got} == {(k, f) for k, f, _ in want}


@pytest.mark.parametrize("capacity", [1, 4, 10])
def test_working_memory_spills_as_a_loop(stateful, tmp_path, capacity):
    r = random.Random(capacity)
    rows = [[(50 * b + i, r.choice(["a", "b"]), 50 * b + i) for i in range(40)] for b in range(3)]
    found = streamed(stateful, tmp_path, rows, "id long, agent_id string, ts_ms long", 50, lambda s: staging.tier_changes(s, capacity=capacity))
    got = {x["id"]: x["tier"] for x in staging.present_tiers(stateful.createDataFrame(found)).collect()}
    working, tiers = {}, {}
    for i, agent, _ in (x for part in rows for x in part):
        held = working.setdefault(agent, [])
        held.append(i)
        tiers[i] = "working"
        if len(held) > capacity:
            for j in held[: len(held) // 2]:
                tiers[j] = "episodic"
            del held[: len(held) // 2]
    assert got == tiers
