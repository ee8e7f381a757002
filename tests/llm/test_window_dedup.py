"""Repeated word windows against brute force."""

import random

import pytest

from recollect.llm.window_dedup import without_repeats


def brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                gone[p : p + window] = [True] * window
            seen.add(w)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def test_brute_force(spark):
    r = random.Random(6)
    words = [f"é{i}" for i in range(50)]
    passages = [r.choices(words, k=25) for _ in range(3)] + [["x"] * 40]
    rows = []
    for i in range(120):
        t = r.choices(words, k=r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            t += r.choice(passages)[r.randint(0, 5) :] + r.choices(words, k=r.randint(0, 8))
        rows.append((r.randrange(10**9) * 2 + i % 2, r.choice([" ", "\n", " \t"]).join(t)))
    rows += [(-5, None), (-4, ""), (-3, "few words"), (-2, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = {x["doc_id"]: (x["n_words"], sum(b - a for a, b in x["removed"]), x["kept"]) for x in without_repeats(df, window=8).collect()}
    assert got == brute(rows, 8)


def test_special_tables(spark):
    text = " ".join(str(i) for i in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text + " " + text)], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["kept"].split() if x["kept"] else []) for x in without_repeats(df).collect())
    # the second copy in document 2 goes for the first, which goes for document 1; windows across the seam start nowhere earlier but are covered
    assert got == [(0, text.split()), (1, text.split()), (1, text.split()), (2, [])]
    assert without_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        without_repeats(df, carry=["kept"])


def test_results_do_not_depend_on_ranges_and_partitions(spark, sf, monkeypatch):
    """Few and many ranges of hashes, few and many shuffle partitions: the same rows (operators 1 and 4)."""
    from recollect.llm import jaccard_join, packed, window_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for partitions, size in (("4", 64 << 20), ("4", 3_000), ("23", 64 << 20)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        monkeypatch.setattr(packed, "RANGE_BYTES", size)
        if size == 3_000:
            assert packed.ranges(docs, "text")[0] > 50
        windows = sorted((r["doc_id"], str(r["removed"])) for r in window_dedup.without_repeats(docs).collect())
        groups = sorted(map(tuple, jaccard_join.similar_groups(docs).collect()))
        seen.append((windows, groups))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
