"""Groups of similar documents against brute force."""

import random

import numpy as np

from recollect.llm import jaccard_join
from recollect.llm.jaccard_join import Trie, similar_groups


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(words, k=30))
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 and texts:
            t = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        else:
            t = r.choices(words, k=r.choice([3, 5, 8, 40, 80, 120]))
            if r.random() < 0.5:
                t += common.split()
            texts.append(" ".join(t))
    return texts


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(x) for x in similar_groups(df, **options).collect()}


def test_brute_force_and_special_texts(spark):
    texts = corpus(1, 120)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one\ttwo"), (1005, "one two three"), (1006, texts[0].upper())]
    assert run(spark, rows) == brute(rows)


def test_units_dealt_into_blocks(spark):
    texts = corpus(2, 100)
    base = texts[5].split() + [f"v{i}" for i in range(100)]
    r = random.Random(3)
    for _ in range(60):
        t = list(base)
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = f"x{r.randrange(50)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    assert run(spark, rows, unit_shingles=700) == brute(rows)


def test_large_units_of_many_sizes(spark):
    r = random.Random(9)
    base, rows = [f"v{i}" for i in range(90)], []
    for i in range(24):  # one common beginning, lengths from 12 to 90: only sets of near sizes link
        t = base[: r.randint(12, 90)]
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows, unit_shingles=400) == brute(rows)


def test_size_classes_of_links_are_neighbours():
    for percent in (75, 90, 100):
        n = np.arange(1, 5000)
        least = jaccard_join.least_overlap(n, percent)  # the smallest set that can link to one of n
        assert (jaccard_join.size_class(n, percent) - jaccard_join.size_class(least, percent) <= 1).all()


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == set()
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    df = spark.createDataFrame([(i, t, "n", "same") for i, t in rows], "doc_id long, text string, n string, component_id string")
    assert sorted(tuple(x) for x in similar_groups(df).collect()) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]


def test_rows_without_a_key_are_counted_and_alone(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (None, text), (None, None), (4, text), (5, text + " h")], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in similar_groups(df).collect())
    assert got == [(0, 0, None), (0, 3, None), (0, 3, None), (4, 3, 4), (5, 4, 4)]


def test_very_long_text(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-50_000])), (3, " ".join(words[: len(words) // 2]))]
    sets = {i: shingles(t) for i, t in rows}
    assert run(spark, rows) == {(1, len(sets[1]), 1), (2, len(sets[2]), 1), (3, len(sets[3]), 3)}


def test_trie_finds_all_links():
    r = random.Random(5)
    for _ in range(200):
        base = r.sample(range(60), 20)
        sets = []
        for _ in range(12):
            s = set(base) if r.random() < 0.7 else set(r.sample(range(60), r.randint(1, 25)))
            for _ in range(r.randint(0, 4)):
                s.discard(r.choice(base))
                s.add(r.randrange(60))
            sets.append(s)
        trie = Trie()
        for s in sets:
            trie.add(tuple(sorted(s)), len(s))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 75 * len(a | b):
                    assert trie.find(i) == trie.find(j)
        for i, a in enumerate(sets):
            fresh = Trie()
            for b in sets:
                fresh.put(tuple(sorted(b)), len(b))
            assert sorted(fresh.linked(frozenset(a), len(a))) == [j for j, b in enumerate(sets) if 100 * len(a & b) >= 75 * len(a | b)]


def test_least_overlap():
    assert [jaccard_join.least_overlap(n, 75) for n in (0, 1, 4, 5, 100)] == [0, 1, 3, 4, 75]
