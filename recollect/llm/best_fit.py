"""Packing documents into sequences of a fixed number of tokens: bounded-space online best fit.

A task packs rows as they come into at most ``open_bins`` open sequences.  These are keyed by
their free space, and a bitset has a bit for every free space that some of them has: the
lowest bit from a piece's length on is the best fit.  Where nothing fits and no more may be
open, the fullest closes.  No row is shuffled for that.

What is open when a task's rows end and isn't nearly full would be space lost in every task.
These pieces, a bounded number of sequences a task, go to a next round: those of MERGED tasks
are packed together, the longest first, and so on until one group is left.  Every round is
written, so that lost executors' work starts from the last one.

Defined results: a null text is empty and has the end token only; rows that repeat are packed
one by one; equal free spaces take the sequence that had it first; texts of any length are
cut into whole sequences behind a first piece with the rest; an empty table has no rows;
carried columns keep their values, and one that is named like a result is an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recollect.llm.byte_bpe import _codec
from recollect.llm.pretokens import read_ranks
from recollect.llm.shared import folder
from recollect.llm.textbatch import pieces as text_pieces
from recollect.shipping import ship

SIZE, OPEN_BINS, MERGED = 2_048, 512, 8
#: A sequence with at most this share of free space is as good as full when a task ends.
NEARLY_FULL = 1 / 128
PIECES = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "ids": "array<int>"}
PLACES = ("sequence_id", "offset")


class OpenBins:
    """At most ``most`` open bins of a size, found by their free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.made = size, most, 0, 0
        self.free = 0  # a bit for every free space
        self.of: list[deque[int]] = [deque() for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bin_ = self.of[space].popleft()
        if not self.of[space]:
            self.free ^= 1 << space
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The bin that a piece goes to, the place in it, and the bins that close by that."""
        closed = []
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count == self.most and length < self.size:
                closed.append(self._take((self.free & -self.free).bit_length() - 1))
            bin_, space, self.made = self.made, self.size, self.made + 1
        left = space - length
        if left:
            self.of[left].append(bin_)
            self.free |= 1 << left
            self.count += 1
        else:
            closed.append(bin_)
        return bin_, self.size - space, closed

    def rest(self) -> list[tuple[int, int]]:
        """What is open: (bin, free space)."""
        return [(bin_, space) for space, bins in enumerate(self.of) for bin_ in bins]


def _packed(batches: Iterator[pa.RecordBatch], size: int, open_bins: int, first_id: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of sequences as they close; at the end rows of open ones, without a sequence (unless it is the last round)."""
    bins = OpenBins(size, open_bins)
    held: pa.Table | None = None
    # of every held row, by its place in the table: bin and offset; and the rows of every open bin
    spots: list[tuple[int, int]] = []

    def rows_of(table: pa.Table, rows: list[int], kept: bool) -> Iterator[pa.RecordBatch]:
        numbers = pa.array([first_id + spots[r][0] if kept else None for r in rows], pa.int64())
        offsets = pa.array([spots[r][1] if kept else None for r in rows], pa.int64())
        out = table.take(pa.array(rows, pa.int64())).append_column("_sequence", numbers).append_column("_offset", offsets)
        yield from out.combine_chunks().to_batches()

    for batch in batches:
        new = pa.Table.from_batches([batch])
        table = new if held is None else pa.concat_tables([held, new])
        done: set[int] = set()
        for length in new["_length"].to_pylist():
            bin_, offset, closed = bins.place(length)
            spots.append((bin_, offset))
            done.update(closed)
        out, keep = [], []
        for r, (bin_, _) in enumerate(spots):
            (out if bin_ in done else keep).append(r)
        if out:
            yield from rows_of(table, out, True)
        held = table.take(pa.array(keep, pa.int64())).combine_chunks()
        spots = [spots[r] for r in keep]
    if held is not None and held.num_rows:
        full = {bin_ for bin_, space in bins.rest() if last or space <= size * NEARLY_FULL}
        rows = range(len(spots))
        for kept in (True, False):
            if some := [r for r in rows if (spots[r][0] in full) == kept]:
                yield from rows_of(held, some, kept)


def _first_round(size: int, open_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in _packed(batches, size, open_bins, task << 32, False):
            yield batch.append_column("_group", pa.array(np.full(batch.num_rows, task, np.int64)))

    return pack


def _next_round(size: int, open_bins: int, number: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        group = table["_group"][0].as_py()
        ordered = table.drop_columns("_group").sort_by([("_length", "descending"), ("_row", "ascending")])
        for batch in _packed(iter(ordered.combine_chunks().to_batches()), size, open_bins, number << 56 | group << 32, last):
            yield batch.append_column("_group", pa.array(np.full(batch.num_rows, group, np.int64)))

    return pack


def packed(df: DataFrame, *, length: str = "length", size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """df with sequence_id and offset for every row, by its ``length`` (1 to ``size``).

    The rounds are packed and written to the shared folder when this is called.
    """
    if clash := set(df.columns) & set(PLACES):
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    spark = df.sparkSession
    ship(spark)
    shared = folder(spark, "best-fit")
    rows = df.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(df.columns)), F.col(length).cast("bigint").alias("_length"), F.monotonically_increasing_id().alias("_row"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, _sequence bigint, _offset bigint, _group bigint"
    rows.mapInArrow(_first_round(size, open_bins), schema).write.parquet(f"{shared}/round=0")
    number = 0
    while True:
        written = spark.read.schema(schema).parquet(f"{shared}/round={number}")
        over = written.where("_sequence is null")
        groups = over.agg(F.max("_group")).first()[0]
        if groups is None:
            break
        number += 1
        above = F.floor(F.col("_group") / MERGED).cast("bigint")
        again = over.drop("_sequence", "_offset").withColumn("_group", above)
        again.groupBy("_group").applyInArrow(_next_round(size, open_bins, number, groups < MERGED), schema).write.parquet(f"{shared}/round={number}")
    done = spark.read.schema(schema).parquet(*(f"{shared}/round={n}" for n in range(number + 1))).where("_sequence is not null")
    return done.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def _cut(shared, token: str, outputs: list[str], size: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(token, shared)
        for rows, buf, offs in text_pieces(batches, "_text"):
            ids, bounds = codec.encode(buf, offs)
            n = np.diff(bounds) + 1
            ids = np.insert(ids.astype(np.uint32), bounds[1:], np.uint32(end))
            ends = np.cumsum(n)
            count = -(-n // size)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            stop = n[doc] - (count[doc] - 1 - piece) * size
            start = np.where(piece == 0, 0, stop - size)
            lo, hi = start + (ends - n)[doc], stop + (ends - n)[doc]
            data = ids.astype("<u4").tobytes()
            made = {
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(hi - lo),
                "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.int64()),
            }
            if "ids" in outputs:  # pieces follow each other without gaps
                made["ids"] = pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            carried = rows.select(rows.schema.names[1:]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(carried.columns + [made[k] for k in outputs], names=rows.schema.names[1:] + outputs)

    return cut


def token_pieces(df: DataFrame, path: str, *, text: str = "text", carry: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("piece", "start", "length", "ids_crc32"), size: int = SIZE, end: int = 0) -> DataFrame:
    """Pieces of at most ``size`` tokens of every text: its ids by a rank file, then the id ``end``.  See PIECES for the outputs."""
    if clash := set(carry) & set(outputs):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: its size is fixed
    rows = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [f"{k} {PIECES[k]}" for k in outputs])
    return rows.mapInArrow(_cut(shared, uuid.uuid4().hex, list(outputs), size, end), schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def packed_documents(df: DataFrame, path: str, *, text: str = "text", carry: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("piece", "start", "length", "ids_crc32"), size: int = SIZE, end: int = 0, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces of all texts with their sequence and the offset in it."""
    if clash := set(carry) & set(PLACES):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    return packed(token_pieces(df, path, text=text, carry=carry, outputs=outputs, size=size, end=end), size=size, open_bins=open_bins)
