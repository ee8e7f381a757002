"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from recollect.llm import suffix_dedup
from recollect.llm.suffix_dedup import longest_previous_factors, without_repeats

LENGTH = 80


def brute(rows, length, keep):
    seen = {}
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in docs:
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    gone = {i: np.zeros(len(b), bool) for i, b in docs}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places if keep == "none" else places[1:]:
                gone[i][s : s + length] = True
    out = {}
    for i, b in docs:
        edge = np.diff(np.concatenate([[0], gone[i].astype(np.int8), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out[i] = (len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[i]]))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(30) for _ in range(4)] + ["ab" * 120, "z" * 300]
    out = []
    for _ in range(n):
        t = text(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            t += " " + (p if r.random() < 0.5 else p[a:b]) + " " + text(r.randint(0, 20))
        out.append(t)
        if r.random() < 0.3:
            t = r.choice(out)
            k = r.randint(0, len(t))
            out.append(t[:k] + r.choice(["", "Q", word()]) + t[k:])
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])) for r in without_repeats(df, length=LENGTH, **options).collect()}


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [500, 2])
def test_brute_force(spark, keep, most):
    rows = [(i * 7 % 997, t) for i, t in enumerate(corpus(most))] + [(2000, None), (2001, ""), (2002, "short")]
    assert run(spark, rows, keep=keep, most=most) == brute(rows, LENGTH, keep)


def test_special_tables(spark):
    assert run(spark, []) == {}
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (1, text, 3), (2, None, 4)], "doc_id long, text string, kept int")
    got = sorted((r["doc_id"] or 0, len(r["removed"]), bytes(r["kept"]).decode()) for r in without_repeats(df, length=LENGTH).collect())
    assert got == [(0, 0, text), (1, 0, text), (1, 0, text), (2, 0, "")]
    with pytest.raises(ValueError):
        without_repeats(df, carry=["kept"])


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [500, 2])
@pytest.mark.parametrize("tasks", [1, 5])
def test_repeated_rows_are_one_document(spark, keep, most, tasks):
    once = [(i * 7 % 997, t) for i, t in enumerate(corpus(most + 1, 30))]
    r = random.Random(5)
    alone = "".join(r.choices("hijkl ", k=300))
    common = "".join(r.choices("mnopq ", k=200))
    # one anchor of several contexts: the ends of what follows and precedes a common string differ
    once += [(2000, alone), *((2001 + k, "".join(r.choices("rstu ", k=100)) + common + "".join(r.choices("rstu ", k=100))) for k in range(4))]
    rows = once * 2 + once[-3:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.coalesce(1) if tasks == 1 else df.repartition(tasks)
    want = brute(once, LENGTH, keep)
    got = [(x["doc_id"], (x["n_bytes"], [tuple(y) for y in x["removed"]], bytes(x["kept"]))) for x in without_repeats(df, length=LENGTH, keep=keep, most=most).collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in rows)
    assert [x for x in got if x[1] != want[x[0]]] == []
    assert want[2000][1] == []


def test_registered_query_on_a_larger_table(spark):
    from conftest import DATA

    from recollect.llm import queries

    folder = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    places = {}
    for i, b in texts.items():
        for s in range(len(b) - 399):
            places.setdefault(hashlib.blake2b(b[s : s + 400], digest_size=12).digest(), []).append((i, s))
    gone = {i: np.zeros(len(b) + 1, np.int32) for i, b in texts.items()}
    for found in places.values():
        for i, s in found if len(found) > 1 else ():
            gone[i][s] += 1
            gone[i][s + 400] -= 1
    for r in queries.op5_suffix_dedup(spark, folder).collect():
        b = texts.pop(r["doc_id"])
        hit = np.cumsum(gone[r["doc_id"]][:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(hit.sum()), spans, kept)
    assert not texts


def common_prefix(t, i, j, most=10**9):
    k = 0
    while k < most and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
        k += 1
    return k


def test_longest_previous_factors():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 30)))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        shared = [common_prefix(t, a, b) for a, b in zip(order, order[1:], strict=False)]
        shared = np.array([0] * bool(t) + shared, np.int64)
        for sign, others in ((1, range), (-1, lambda i: range(i + 1, len(t)))):
            want = [max((common_prefix(t, i, j) for j in others(i)), default=0) for i in order]
            assert longest_previous_factors(sign * np.array(order, np.int64), shared).tolist() == want


@pytest.mark.parametrize("length", [8, 20, 64, 100, 240, 400])
def test_suffix_array(length):
    r = random.Random(length)
    texts = ["".join(r.choices("ab" if k % 2 else "a", k=length + r.randint(0, 60))) for k in range(12)]
    texts += [t[:20] + "c" + t[20:] for t in texts] + ["ab" * length]
    group = [k % 3 for k in range(len(texts))]
    text = "".join(texts).encode()
    starts, of, at = [], [], 0
    for t, g in zip(texts, group, strict=True):
        starts += range(at, at + len(t) - length + 1)
        of += [g] * (len(t) - length + 1)
        at += len(t)
    order, shared = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), np.array(starts), np.array(of), length)
    keys = [(of[i], text[starts[i] : starts[i] + length]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(starts)))
    want = [0] + [common_prefix(text, starts[a], starts[b], length) if of[a] == of[b] else 0 for a, b in zip(order, order[1:], strict=False)]
    assert shared.tolist() == want


def test_anchors_agree_between_equal_windows():
    r = random.Random(4)
    common = bytes(r.choices(range(97, 123), k=300))
    a, b = bytes(r.choices(range(97, 123), k=130)) + common, common + bytes(r.choices(range(97, 123), k=77))
    buf = np.frombuffer(a + b, np.uint8)
    doc, start, size, _, g, _ = suffix_dedup.anchored_runs(buf, np.array([0, len(a), len(a) + len(b)]), 100)
    owner = {}
    for d, s, n, h in zip(doc.tolist(), start.tolist(), size.tolist(), g.tolist(), strict=True):
        for x in range(s, s + n - 99):
            owner[d, x] = h
    assert all(owner[0, 130 + x] == owner[1, x] for x in range(201))
    assert len(owner) == len(a) + len(b) - 198
