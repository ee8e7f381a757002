"""Benchmark hits against brute force."""

import random

from pyspark.sql import functions as F

from recollect.llm.decontaminate import SuffixAutomaton, benchmark_hits, decontaminated, normal_words, united


def brute(words, items, window):
    hit, names = [False] * len(words), set()
    for name, item in items:
        k = min(window, len(item))
        for s in range(len(item) - k + 1) if item else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == item[s : s + k]:
                    names.add(name)
                    hit[p : p + k] = [True] * k
    return hit, names


def test_automaton():
    r = random.Random(1)
    for _ in range(2000):
        letters = [b"a", b"b", b"c"][: r.randint(1, 3)]
        items = [(str(i), [r.choice(letters) for _ in range(r.randint(0, 9))]) for i in range(r.randint(0, 4))]
        window, words = r.randint(1, 5), [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 25))]
        spans, names = SuffixAutomaton(items, window).scan(words)
        got = [False] * len(words)
        for a, b in spans:
            got[a:b] = [True] * (b - a)
        assert (got, names) == brute(words, items, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_normal_words():
    assert normal_words("Été-CAFÉ 2go_x\n|İ") == ["Été".encode(), "cafÉ".encode(), b"2go", b"x", "İ".encode()]
    assert normal_words(None) == normal_words("") == []


def test_blocks_and_special_rows(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(30)] + [(50, None), (51, "!?"), (None, "w1"), (3, "w3 w3 w3")]
    docs = []
    for i in range(60):
        t = r.choices(words, k=r.randint(0, 40))
        if r.random() < 0.5:
            t += (r.choice(items[:30])[1]).split() + r.choices(words, k=5)
        docs.append((i, " ".join(t)))
    docs += [(100, None), (101, ""), (102, "...")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i), normal_words(t)) for i, t in items if i is not None]
    for size in (200_000, 100):
        got = {x["doc_id"]: x for x in benchmark_hits(df, bench, block_words=size).collect()}
        clean = {x["doc_id"] for x in decontaminated(df, bench, block_words=size).collect()}
        for i, t in docs:
            own = normal_words(t)
            hit, names = brute(own, named, 13)
            marked = [False] * len(own)
            for a, b in got[i]["spans"]:
                marked[a:b] = [True] * (b - a)
            assert (got[i]["n_words"], marked, set(got[i]["items"])) == (len(own), hit, names)
            assert (i in clean) == (not (sum(hit) and 20 * sum(hit) >= len(own)))
    assert decontaminated(df, bench).columns == df.columns
    assert benchmark_hits(df.limit(0), bench).count() == 0
    assert {tuple(x["items"]) for x in benchmark_hits(df, bench.limit(0)).collect()} == {()}


def test_items_without_an_id_in_any_number_of_blocks(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(30)] + [(50, None), (51, "!?"), (None, "w1"), (None, "w2 w3"), (3, "w3 w3 w3")]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 40)) + (items[r.randrange(30)][1].split() if i % 2 else []))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "w1"), (104, "w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = [(None if i is None else str(i), normal_words(t)) for i, t in items]
    for size in (200_000, 100):
        got = {x["doc_id"]: x for x in benchmark_hits(df, bench, block_words=size).collect()}
        clean = {x["doc_id"] for x in decontaminated(df, bench, block_words=size).collect()}
        for i, t in docs:
            own = normal_words(t)
            hit, names = brute(own, every, 13)
            marked = [False] * len(own)
            for a, b in got[i]["spans"]:
                marked[a:b] = [True] * (b - a)
            assert (got[i]["n_words"], marked, set(got[i]["items"])) == (len(own), hit, names - {None})
            assert (i in clean) == (not (sum(hit) and 20 * sum(hit) >= len(own)))
    assert decontaminated(df, bench).columns == df.columns
    assert benchmark_hits(df.limit(0), bench).count() == 0
    assert {tuple(x["items"]) for x in benchmark_hits(df, bench.limit(0)).collect()} == {()}


def test_null_and_repeated_ids_in_any_number_of_blocks(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(words, k=20))) for i in range(30)]
    other = " ".join(r.choices("abcdef", k=30))
    bad = [f"{items[i][1]} {items[i + 1][1]}" for i in range(3)]
    docs = [(None, bad[0]), (None, bad[1] + " x"), (None, other), (None, None), (1, bad[2]), (1, bad[2]), (1, other), (2, other), (2, other), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda d: sorted(repr(tuple(x)) for x in d.collect())
    named = [(str(i), normal_words(t)) for i, t in items]
    want = []
    for i, t in docs:
        hit, names = brute(normal_words(t), named, 13)
        want.append((i, len(hit), sum(hit), sorted(names)))
    for size in (200_000, 100):
        hits = benchmark_hits(df, bench, block_words=size)
        assert hits.columns == ["doc_id", "n_words", "spans", "items"]
        assert sorted(repr((x["doc_id"], x["n_words"], sum(b - a for a, b in x["spans"]), x["items"])) for x in hits.collect()) == sorted(map(repr, want))
        assert rows(decontaminated(df, bench, block_words=size)) == sorted(repr(x) for x in docs if x[1] not in (bad[0], bad[1] + " x", bad[2]))


def test_united(spark):
    df = spark.createDataFrame([([[5, 9], [0, 2], [8, 12], [2, 3]],), ([],)], "s array<array<bigint>>")
    assert [r[0] for r in df.select(united(F.col("s"))).collect()] == [[[0, 3], [5, 12]], []]
