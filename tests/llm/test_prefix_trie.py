"""The trie against plain Python, with and without Spark."""

import hashlib
import random
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import prefix_trie
from recollect.llm.prefix_trie import DIGEST

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """convs: id -> [(turn, size)]; rows of the trie."""
    members = {}
    sizes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            k = tuple(t for t, _ in turns[:d])
            members.setdefault(k, []).append(c)
            sizes[k] = turns[d - 1][1] if d else 0
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    rows = []
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * sizes[k]
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[0], r[1]))


def made(r, n, depth, words):
    convs = {}
    for _ in range(n):
        copied = r.choice(list(convs.values())) if convs and r.random() < 0.6 else []
        head = copied[: r.randint(0, len(copied))] if r.random() < 0.7 else copied
        c = r.randint(-500, 10**6)
        convs.setdefault(c, [*head, *((w, len(w)) for w in (r.choice(words) for _ in range(r.randint(0, depth))))][:12])
    return convs


@pytest.mark.parametrize("seed", range(12))
def test_slices_and_stitching(monkeypatch, seed):
    """Any cut of the sorted conversations into slices gives the same nodes."""
    r = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", r.choice([8, 40, 1 << 20]))
    monkeypatch.setattr(prefix_trie, "WAITING", r.choice([1, 3, 10_000]))
    words = ["a", "bb", "ccc"][: r.randint(1, 3)]
    convs = made(r, r.choice([1, 5, 60, 300]), r.randint(0, 5), words)
    symbol = {w: hashlib.sha256(w.encode()).digest()[:DIGEST] for w in words}
    rows = sorted((b"".join(symbol[w] for w, _ in turns), c, [s for _, s in turns]) for c, turns in convs.items())
    cuts = sorted({0, len(rows), *(r.randint(0, len(rows)) for _ in range(r.choice([0, 2, 10, 200])))})
    out = []
    for n, (lo, hi) in enumerate(pairwise(cuts)):
        own = prefix_trie.Slice(n)
        for row in rows[lo:hi]:
            own.add(*row)
        own.finish()
        out += [x for b in own.out.batches() for x in b.to_pylist()]
    borders = sorted((x for x in out if x["kind"] in (prefix_trie.OPEN, prefix_trie.ENDS)), key=lambda x: (x["slice"], x["side"], x["depth"], x["kind"], x["size"]))
    nodes = [x for x in out if x["kind"] in (prefix_trie.DONE, prefix_trie.ASKS)]
    batch = pa.RecordBatch.from_pylist(borders, schema=prefix_trie._SCHEMA)
    nodes += [x for b in prefix_trie.stitch(iter([batch])) for x in b.to_pylist()]
    found = {x["id"]: x["conv_id"] for x in nodes if x["id"] is not None}
    for x in nodes:
        if x["kind"] == prefix_trie.ASKS:
            x["parent_conv_id"] = found[x["parent_id"]]
    assert sorted((tuple(x[c] for c in COLUMNS) for x in nodes), key=lambda x: (x[0], x[1])) == plain(convs)


def rebuilt(rows, base, n):
    lists = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = f"{len(role.encode())}:{role}{text}".encode()
            lists.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(said).digest()[:DIGEST], ((role, text), len(text.encode()))))
    lists = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in lists.items()}
    return {c: [*lists.get(base(c), [])[: n(c)], *v[n(c) :]] for c, v in lists.items()}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_rebuilt_conversations(spark, partitions):
    r = random.Random(partitions)
    texts = [None, "", "hi", "été", "x" * 3000]
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 1, 2, 3, 4, 5, 6]), r.choice([None, "user", "assistant"]), r.choice(texts)) for _ in range(700)]
    rows += [(c, t, "user", "same") for c in range(100, 400) for t in range(2)]  # copies
    rows += rows[:50]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_all", F.lit(1)).withColumn("turns", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conv = F.col("conv_id")
    heads = prefix_trie.trie_nodes(prefix_trie.with_shared_heads(df, conv - conv % 5, conv % 4)).collect()
    own = prefix_trie.trie_nodes(prefix_trie.turn_lists(df)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    by = lambda x: (x[0], x[1])
    assert sorted(map(tuple, heads), key=by) == plain(rebuilt(rows, lambda c: c - c % 5, lambda c: c % 4))
    assert sorted(map(tuple, own), key=by) == plain(rebuilt(rows, lambda c: c, lambda c: 0))


def test_no_turns_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie_nodes(prefix_trie.turn_lists(spark.createDataFrame([], schema))).collect() == []
    one = spark.createDataFrame([(7, 0, "user", "hi")], schema)
    gone = prefix_trie.trie_nodes(prefix_trie.with_shared_heads(one, F.lit(5), F.lit(3))).collect()
    assert [tuple(x) for x in gone] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]
