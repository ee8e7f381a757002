"""Counting hashes across a corpus: columns of numbers packed into binary cells.

Rows of (hash, number) would cost a JVM row each.  Tasks instead send, for every range of
hashes, one row with all their hashes of that range as a binary cell: sorted, as
differences, by byte planes, which the shuffle's compression shrinks.  Spark groups the
cells by range, and a function gets one range at a time.  There are as many ranges as the
texts' bytes ask for, so that a range has some ``RANGE_BYTES`` of text at most, whatever the
number of shuffle partitions, and at least ``RANGES`` for each of those.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hashes that a task gathers before it hands them on.
GATHERED = 1_000_000
#: Ranges for each shuffle partition: of hashes, which take more memory unpacked, and for what goes back to documents.
RANGES, BACK_RANGES = 3, 1
#: Bytes of text whose hashes make a range: some ten million hashes, a few hundred MB in a function.
RANGE_BYTES = 64 << 20

#: key: which range; kind: what the cells hold.
PACKED = "key int, kind int, a binary, b binary, c binary"


def planes(x: np.ndarray) -> bytes:
    """The bytes of all numbers, the first byte of each first."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(cell: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers."""
    out = x.copy()
    out[1:] -= x[:-1]
    return planes(out)


def unpack_sorted(cell: bytes) -> np.ndarray:
    return np.cumsum(from_planes(cell, np.uint64), dtype=np.uint64)


def ranges(rows: DataFrame, text: str = "_text") -> tuple[int, int]:
    """How many ranges there are of either kind, from the size of the texts and the number of shuffle partitions.

    A range of the first kind sends a cell to every one of the second, so those are fewer.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return max(RANGES * n, -(-size // RANGE_BYTES)), max(BACK_RANGES * n, -(-size // (2 * RANGE_BYTES)))


def slots(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash, of n; sorted hashes have sorted ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs_of(sorted_slots: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slot, start, end) of every run of equal slots."""
    if len(sorted_slots):
        starts = np.flatnonzero(np.concatenate([[True], sorted_slots[1:] != sorted_slots[:-1]]))
        for slot, lo, hi in zip(sorted_slots[starts].tolist(), starts.tolist(), np.append(starts[1:], len(sorted_slots)).tolist(), strict=True):
            yield slot, lo, hi


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "kind", "a", "b", "c"])


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """All cells of a range: kind -> [(a, b, c)]."""
    out: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for kind, a, b, c in zip(*(column.to_pylist() for column in batch.columns[1:]), strict=True):
            out[kind].append((a, b, c))
    return out


def noted(batches: Iterator[pa.RecordBatch], keys: set[int]) -> Iterator[pa.RecordBatch]:
    """The same batches; keys learns their range."""
    for batch in batches:
        keys.add(batch.column(0)[0].as_py())
        yield batch
