"""Packing against plain loops and the public tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recollect.llm import best_fit
from recollect.llm.queries import op12_best_fit

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_best_fit(lengths, size, most):
    """(bin, offset) of every length and the bins in the order of closing."""
    free, placed, closed = {}, [], []
    made = 0
    age = {}
    for n, length in enumerate(lengths):
        fits = [(space, age[b], b) for b, space in free.items() if space >= length]
        if fits:
            space, _, b = min(fits)
        else:
            if len(free) == most and length < size:
                _, _, worst = min((s, age[x], x) for x, s in free.items())
                closed.append(worst)
                del free[worst]
            b, space, made = made, size, made + 1
        placed.append((b, size - space))
        free[b], age[b] = space - length, n
        if not free[b]:
            del free[b]
            closed.append(b)
    return placed, closed


@pytest.mark.parametrize("size,most,n", [(10, 3, 400), (64, 8, 600), (2048, 16, 500), (1, 1, 20)])
def test_open_bins_against_a_loop(size, most, n):
    r = random.Random(size)
    lengths = [r.randint(1, size) for _ in range(n)]
    bins = best_fit.OpenBins(size, most)
    placed, closed = [], []
    for length in lengths:
        b, offset, gone = bins.place(length)
        placed.append((b, offset))
        closed += gone
        assert bins.count <= most
    assert (placed, closed) == plain_best_fit(lengths, size, most)


def check(rows, size):
    """Every sequence is gapless from 0 and not too long; how many there are, and the least that there could be."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(sequences), -(-sum(r["length"] for r in rows) // size)


@pytest.mark.parametrize("parts,open_bins", [(1, 4), (5, 8), (40, 8)])
def test_rounds_keep_every_row(spark, parts, open_bins):
    r = random.Random(parts)
    rows = [(k // 2, r.choice([1, 1, 3, 40, 99, 100, r.randint(1, 100)])) for k in range(3000)] + [(7, 55)] * 50
    found = best_fit.packed(spark.createDataFrame(rows, "doc_id long, length int").repartition(parts), size=100, open_bins=open_bins)
    got = found.collect()
    assert sorted((x["doc_id"], x["length"]) for x in got) == sorted(rows)
    n, least = check(got, 100)
    assert n <= 1.06 * least + 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, got))


def test_pieces_against_the_public_tokenizer(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "<|endoftext|>"), (-5, "😀" * 3000), (-6, "a" * 5000), (-6, "a" * 5000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = best_fit.packed_documents(docs, RANKS, outputs=["piece", "start", "length", "ids_crc32", "ids"]).collect()
    texts = defaultdict(list)
    for d in docs.collect():
        texts[d["doc_id"]].append(d["text"])
    found = defaultdict(list)
    for x in rows:
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and len(x["ids"]) == x["length"]
        found[x["doc_id"]].append((x["piece"], x["start"], x["ids"]))
    want = {}
    for doc, own in texts.items():
        want[doc] = []
        for text in own:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            first = len(ids) % 2048 or 2048
            bounds = [0, *range(first, len(ids) + 1, 2048)] if ids else []
            want[doc] += [(k, lo, ids[lo:hi]) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]
        want[doc].sort()
    assert {k: sorted(v) for k, v in found.items()} == want


def test_query_is_near_the_least_number_of_sequences(spark, sf):
    n, least = check(op12_best_fit(spark, sf).collect(), best_fit.SIZE)
    assert n <= 1.03 * least + 1


def test_empty_tables_and_clashes(spark):
    assert best_fit.packed_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS).collect() == []
    odd = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, _row int, _0 int, _length int")
    assert [tuple(x)[:4] for x in best_fit.packed_documents(odd, RANKS, carry=["doc_id", "_row", "_0", "_length"]).collect()] == [(1, 5, 6, 7)]
    for name in ("length", "piece", "sequence_id", "offset"):
        with pytest.raises(ValueError, match=name):
            best_fit.packed_documents(spark.createDataFrame([], f"doc_id long, text string, {name} long"), RANKS, carry=["doc_id", name])
