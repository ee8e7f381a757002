"""Substring dedup over words: Rabin-Karp hashes of every window, counted across the corpus.

Every window of ``window`` consecutive words gets a rolling hash.  Tasks send their hashes
in packed cells, one for each range of hashes, each hash once with the smallest document
that has it.  Spark groups the cells by range, so equal hashes meet, and every document but
the smallest learns which of its windows start earlier elsewhere; within a document the
first start stays.  Overlapping repeated windows merge into maximal runs of removed words.

A hash that a third of all documents share leaves each task once, so its range gets no more
than one entry per task for it.  Hashes have 64 bits.

Defined results: null text has no words; a text shorter than the window keeps everything;
rows with a null key keep their text apart from repeats within themselves, and count for
no other; rows that share a key, whatever their texts, are not compared with each other;
extra columns are ignored unless carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recollect.llm import packed
from recollect.shipping import ship
from recollect.llm.textbatch import SPACE, byte_sums, mix, pieces, span_hashes, window_hashes, words

WINDOW = 20
HASHES, LATER = 0, 1


def _windows(buf: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's document; the windows' first words and hashes; each document's first word."""
    starts, ends, doc = words(buf, offs, SPACE)
    h, whole = window_hashes(span_hashes(byte_sums(buf), starts, ends), doc, window)
    at = np.flatnonzero(whole)
    return doc, at, h[at], np.searchsorted(doc, np.arange(len(offs)))


def _sender(window: int, n: int, back: int):
    def rows(h: np.ndarray, d: np.ndarray) -> list[tuple]:
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        out = [(s, HASHES, packed.pack_sorted(h[first][lo:hi]), packed.planes(d[first][lo:hi]), None) for s, lo, hi in packed.runs_of(packed.slots(h[first], n))]
        return out + later_rows(h[~first], d[~first], back)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch, buf, offs in pieces(batches, "_text"):
            doc, at, h, _ = _windows(buf, offs, window)
            held.append((h, batch.column(1).to_numpy()[doc[at]]))
            size += len(h)
            if size >= packed.GATHERED:
                yield packed.packed_batch(rows(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held, size = [], 0
        if size:
            yield packed.packed_batch(rows(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return send


def later_rows(h: np.ndarray, d: np.ndarray, back: int) -> list[tuple]:
    """Cells that tell documents which of their hashes start earlier elsewhere."""
    slot = packed.slots(mix(d.view(np.uint64)), back)
    order = np.lexsort((h, slot))
    return [(s, LATER, packed.pack_sorted(h[order[lo:hi]]), packed.planes(d[order[lo:hi]]), None) for s, lo, hi in packed.runs_of(slot[order])]


def _judge(back: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: set[int] = set()
        cells = packed.gathered(packed.noted(batches, keys))
        if cells[LATER]:
            yield packed.packed_batch([(*keys, LATER, *x) for x in cells[LATER]])
        if held := cells[HASHES]:
            h = np.concatenate([packed.unpack_sorted(a) for a, _, _ in held])
            d = np.concatenate([packed.from_planes(b, np.int64) for _, b, _ in held])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            least = d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = d != least
            yield packed.packed_batch(later_rows(h[later], d[later], back))

    return judge


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, its hashes that start earlier elsewhere)"""
    if held := packed.gathered(batches)[LATER]:
        h = np.concatenate([packed.unpack_sorted(a) for a, _, _ in held])
        d = np.concatenate([packed.from_planes(b, np.int64) for _, b, _ in held])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        found = list(packed.runs_of(d))
        offsets = pa.array(np.array([lo for _, lo, _ in found] + [len(d)], np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["_document", "_later"])


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in pieces(batches, "_text"):
            n = batch.num_rows
            doc, at, h, first_word = _windows(buf, offs, window)
            own = mix(h + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            told = batch.column(1)
            later = told.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(told), 0).to_numpy()).astype(np.uint64)
            gone = np.isin(own, mix(later + of * np.uint64(0x9E3779B97F4A7C15)))
            _, first = np.unique(own, return_index=True)
            again = np.ones(len(own), bool)
            again[first] = False  # the first start within the document
            starts = at[gone | again]
            cover = np.zeros(len(doc) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            removed = np.cumsum(cover[:-1]) > 0
            edge = np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8))
            # runs never cross documents: cut them where a document begins
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans: list[list] = [[] for _ in range(n)]
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                while a < b:
                    d = int(doc[a])
                    end = min(b, int(first_word[d + 1]))
                    spans[d].append([a - int(first_word[d]), end - int(first_word[d])])
                    a = end
            keep = ~removed
            kept = []
            data = buf.tobytes()
            for d in range(n):
                own_words = data[offs[d] : offs[d + 1]].split()
                kept.append(b" ".join(compress(own_words, keep[first_word[d] : first_word[d + 1]].tolist()) if spans[d] else own_words))
            arrays = [pa.array(np.diff(first_word)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns[2:] + arrays, names=batch.schema.names[2:] + ["n_words", "removed", "kept"])

    return remove


def later_windows(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_document, _later): the hashes of the windows that also occur in a smaller document."""
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(key).isNotNull()).select(F.col(text).alias("_text"), F.col(key).cast("bigint").alias("_key"))
    n, back = packed.ranges(rows)
    sent = rows.mapInArrow(_sender(window, n, back), packed.PACKED)
    told = sent.groupBy("key").applyInArrow(_judge(back), packed.PACKED)
    return told.groupBy("key").applyInArrow(_by_document, "_document bigint, _later array<bigint>")


def without_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, removed (word runs [start, end)) and kept (the other words, joined by blanks).

    ``key`` is a whole number that orders the documents.
    """
    if clash := set(carry) & {"n_words", "removed", "kept"}:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    later = later_windows(df, key=key, text=text, window=window)
    number = F.col(key).cast("bigint")
    # rows without a key are dealt by their text
    rows = df.select(F.col(text).alias("_text"), number.isNotNull().alias("_has_key"), F.coalesce(number, F.xxhash64(F.col(text))).alias("_key"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    both = rows.join(later.hint("shuffle_hash"), rows["_key"] == later["_document"], "left").select("_text", F.when(F.col("_has_key"), F.col("_later")).alias("_later"), *(f"_{k}" for k in range(len(carry))))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + ["n_words bigint, removed array<array<bigint>>, kept string"])
    return both.mapInArrow(_remover(window), schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})
