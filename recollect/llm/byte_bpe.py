"""Byte-level BPE encoding and decoding with segment trees.

Each distinct pre-token is encoded once and remembered in the task (found again by a hash,
told equal by its bytes).  A segment tree over its byte
positions holds, in every node, the leftmost pair of least rank; the root names the next
merge.  A merge changes three leaves (the merged position, its right neighbour that
vanishes, and the live neighbour before it) and so takes a logarithmic number of updates.
The trees of all distinct pre-tokens of one size class are one numpy array and advance
together; a pre-token of over 64 bytes has a tree of its own.

Defined results: null counts as empty text; empty text has no ids and decodes to empty
bytes; rows that repeat are independent; carried columns keep their values, whatever
their names (a result column of the same name as a carried one is an error).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.llm.pretokens import pretokens, read_ranks
from recollect.shipping import ship
from recollect.llm.textbatch import SpanTable, pieces, ragged

NONE = np.int64(1) << 50
BATCHED_BYTES = 64
#: Pre-tokens whose ids a task remembers from batch to batch, before it starts anew.
MOST_KNOWN = 1_000_000

OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


class BytePairCodec:
    """Encodes and decodes by a table of ranks: token bytes -> rank, which is also its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(list(self.pairs.values()), np.int64)[order], 0)
        self._forget()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.ranks[k], NONE)

    def encode_one(self, data: bytes) -> list[int]:
        """One pre-token, with a segment tree of its own."""
        n = len(data)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.byte_rank[b]) for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        far = (1 << 60, 0)
        tree = [far] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            if i < 0 or after[i] >= n:
                return far
            rank = self.pairs.get((ids[i], ids[after[i]]))
            return far if rank is None else (rank, i)

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        gone = [False] * n
        while tree[1] < far:
            rank, i = tree[1]
            j = after[i]
            ids[i], gone[j] = rank, True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, value in ((j, far), (i, leaf(i)), (before[i], leaf(before[i]))):
                if k >= 0:
                    k += width
                    tree[k] = value
                    while k > 1:
                        k >>= 1
                        tree[k] = min(tree[2 * k], tree[2 * k + 1])
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def _encode_class(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte rows of one width, padded: all ids row by row, and how many each row has."""
        n, width = data.shape
        ids = self.byte_rank[data]
        place = np.arange(width)
        live = place < size[:, None]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE * width, np.int64)
        if width > 1:
            rank = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            tree[:, width:-1] = np.where(live[:, 1:], rank, NONE) * width + place[:-1]
        for k in range(width.bit_length() - 2, -1, -1):
            low = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(low[:, ::2], low[:, 1::2])
        rows = np.arange(n)
        limit = NONE * width
        flat = tree.reshape(-1)

        def update(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            top, node = r * (2 * width), i + width
            flat[top + node] = value
            for _ in range(width.bit_length() - 1):
                node >>= 1
                low = top + 2 * node
                flat[top + node] = np.minimum(flat[low], flat[low + 1])

        while len(rows := rows[tree[rows, 1] < limit]):
            rank, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            ids[rows, i] = rank
            live[rows, j] = False
            nxt = after[rows, j]
            after[rows, i] = nxt
            update(rows, j, np.full(len(rows), limit))
            has = nxt < size[rows]
            safe = np.where(has, nxt, 0)
            r, k = rows[has], nxt[has]
            before[r, k] = i[has]
            update(rows, i, np.where(has, self._pair_ranks(rank, ids[rows, safe]), NONE) * width + i)
            prev = before[rows, i]
            if len(some := np.flatnonzero(prev >= 0)):
                r, p = rows[some], prev[some]
                update(r, p, self._pair_ranks(ids[r, p], rank[some]) * width + p)
        return ids[live], live.sum(1)

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given pre-tokens: all ids in a row, where each pre-token's begin, and how many it has."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        begin = np.zeros(len(starts), np.int64)
        found, total, width = [], 0, 1
        while width <= BATCHED_BYTES:
            some = np.flatnonzero((size <= width) & (size > width // 2))
            for part in np.array_split(some, len(some) * width // (1 << 20) + 1):
                if not len(part):
                    continue
                places = starts[part, None] + np.minimum(np.arange(width), size[part, None] - 1)
                ids, n = self._encode_class(buf[places], size[part])
                counts[part], begin[part] = n, total + np.cumsum(n) - n
                found.append(ids)
                total += len(ids)
            width *= 2
        for k in np.flatnonzero(size > BATCHED_BYTES):
            ids = np.array(self.encode_one(buf[starts[k] : ends[k]].tobytes()), np.int64)
            counts[k], begin[k] = len(ids), total
            found.append(ids)
            total += len(ids)
        return np.concatenate(found) if found else np.zeros(0, np.int64), begin, counts

    def _forget(self) -> None:
        self.seen = SpanTable()
        self.seen_ids = np.zeros(0, np.int32)
        self.seen_begin = self.seen_counts = np.zeros(0, np.int64)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of documents, and each document's bounds among them."""
        starts, ends, doc = pretokens(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        if len(self.seen) > MOST_KNOWN:
            self._forget()
        number, new = self.seen.number(buf, starts, ends)
        if len(new):
            ids, begin, counts = self.encode_spans(buf, starts[new], ends[new])
            self.seen_begin = np.concatenate([self.seen_begin, begin + len(self.seen_ids)])
            self.seen_counts = np.concatenate([self.seen_counts, counts])
            self.seen_ids = np.concatenate([self.seen_ids, ids.astype(np.int32)])
        each = self.seen_counts[number]
        bounds = np.zeros(len(offs), np.int64)
        np.cumsum(np.bincount(doc, each, len(offs) - 1), out=bounds[1:])
        return self.seen_ids[ragged(self.seen_begin[number], each)], bounds

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[str, BytePairCodec] = {}


def _codec(token: str, shared) -> BytePairCodec:
    """The worker's codec, built once."""
    if token not in _codecs:
        _codecs.clear()
        _codecs[token] = BytePairCodec(shared.value)
    return _codecs[token]


def _coder(shared, token: str, outputs: list[str], encode: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(token, shared)
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}

        def texts() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            if encode:
                for rows, buf, offs in pieces(batches, "_text"):
                    yield rows, *codec.encode(buf, offs)
            else:
                for rows in batches:
                    lists = [x.as_py() or [] for x in rows.column(0)]
                    yield rows, np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])

        for rows, ids, bounds in texts():
            made: dict[str, list] = {k: [] for k in outputs if k not in ("ids", "n_tokens")}
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if made else ():
                own = ids[lo:hi].tolist()
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(",".join(map(codec.names.__getitem__, own)).encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    data = codec.decode(own)
                    if "decoded" in made:
                        made["decoded"].append(data)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            arrays = {k: pa.array(v, types[k]) for k, v in made.items()}
            arrays["n_tokens"] = pa.array(np.diff(bounds))
            if "ids" in outputs:
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(rows.columns[1:] + [arrays[k] for k in outputs], names=rows.schema.names[1:] + outputs)

    return code


def _coded(df: DataFrame, column: str, path: str, carry: Sequence[str], outputs: Sequence[str], encode: bool) -> DataFrame:
    if clash := set(carry) & set(outputs):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: its size is fixed
    rows = df.select(F.col(column).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [f"{k} {OUTPUTS[k]}" for k in outputs])
    return rows.mapInArrow(_coder(shared, uuid.uuid4().hex, list(outputs), encode), schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def encoded(df: DataFrame, path: str, *, text: str = "text", carry: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("ids", "n_tokens")) -> DataFrame:
    """The carried columns and the outputs (see OUTPUTS) of encoding ``text`` by a rank file, then decoding the ids."""
    return _coded(df, text, path, carry, outputs, True)


def decoded(df: DataFrame, path: str, *, ids: str = "ids", carry: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("decoded",)) -> DataFrame:
    """The carried columns and the outputs of decoding an array of ids (null: no ids)."""
    return _coded(df, ids, path, carry, outputs, False)
