"""Token counts by a unigram model, with dynamic programming shared in a trie.

The distinct pre-tokens of a batch go into a trie of bytes.  For every trie node the
forward score, the best sum of piece scores over the ways to cut the bytes down to that
node into pieces, is computed once, however many pre-tokens share the prefix; a node
where a pre-token ends stores that pre-token's token count.  All nodes of one depth are
computed together.  Distinct pre-tokens are remembered in the task, found again by a hash
and told equal by their bytes.

The pieces are those of a public rank file.  A piece's score falls with the logarithm of
its rank (Zipf's law), in whole numbers, so sums are exact; every piece costs one more,
so that of equal sums the one with fewer pieces wins.

Defined results: null counts as empty text; empty text has no pre-tokens and no tokens;
rows that repeat are independent; carried columns keep their values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.llm.pretokens import pretokens, read_ranks
from recollect.shipping import ship
from recollect.llm.textbatch import SpanTable, byte_sums, pieces, span_hashes

#: Longer pre-tokens are scored one by one.
TRIE_BYTES = 64
#: Counts of pre-tokens that a task remembers from batch to batch, before it starts anew.
MOST_KNOWN = 1_000_000


def piece_score(rank: int) -> int:
    return -round(65536 * float(np.log(rank + 2))) * 4096 - 1


class UnigramCounter:
    def __init__(self, ranks: dict[bytes, int]):
        self.scores = {t: piece_score(r) for t, r in ranks.items()}
        tokens = list(self.scores)
        size = np.array([len(t) for t in tokens])
        ends = np.cumsum(size)
        sums = byte_sums(np.frombuffer(b"".join(tokens), np.uint8))
        hashes = span_hashes(sums, ends - size, ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.array(list(self.scores.values()), np.int64)[order]
        self.sizes = np.unique(size).tolist()
        self.longest = max(self.sizes)
        self._forget()

    def _forget(self) -> None:
        self.seen, self.seen_counts = SpanTable(), np.zeros(0, np.int64)

    def count_one(self, data: bytes) -> int:
        """The number of pieces of the best cut of one pre-token."""
        best, pieces_ = [0], [0]
        for end in range(1, len(data) + 1):
            score, n = max((best[s] + self.scores[data[s:end]], -pieces_[s] - 1) for s in range(max(0, end - self.longest), end) if data[s:end] in self.scores)
            best.append(score)
            pieces_.append(-n)
        return pieces_[-1]

    def _count_in_trie(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same for rows of bytes with the given sizes, by the depth of the trie's nodes."""
        n, width = data.shape
        sums = byte_sums(data.ravel())
        node = np.zeros((n, width + 1), np.int64)  # of each pre-token's prefix of each length
        best, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]  # by depth and node
        rows, out = np.arange(n), np.zeros(n, np.int64)
        for depth in range(1, int(size.max()) + 1):
            rows = rows[size[rows] >= depth]
            _, first, which = np.unique(node[rows, depth - 1] << 8 | data[rows, depth - 1], return_index=True, return_inverse=True)
            node[rows, depth] = which
            sample = rows[first]  # a pre-token through each node
            score = np.full(len(sample), np.iinfo(np.int64).min)
            pieces_ = np.zeros(len(sample), np.int64)
            for length in self.sizes:
                if length > depth:
                    break
                at = depth - length
                h = span_hashes(sums, sample * width + at, sample * width + depth)
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[k] == h)
                before = node[sample[hit], at]
                value = best[at][before] + self.values[k[hit]]
                better = value > score[hit]
                hit = hit[better]
                score[hit] = value[better]
                pieces_[hit] = counts[at][before[better]] + 1
            best.append(score)
            counts.append(pieces_)
            done = rows[size[rows] == depth]
            out[done] = pieces_[node[done, depth]]
        return out

    def count_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= TRIE_BYTES)
        if len(short):
            width = int(size[short].max())
            out[short] = self._count_in_trie(buf[starts[short, None] + np.minimum(np.arange(width), size[short, None] - 1)], size[short])
        for k in np.flatnonzero(size > TRIE_BYTES):
            out[k] = self.count_one(buf[starts[k] : ends[k]].tobytes())
        return out

    def count(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document, its pre-tokens and its tokens."""
        starts, ends, doc = pretokens(buf, offs)
        n = len(offs) - 1
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(self.seen) > MOST_KNOWN:
            self._forget()
        number, new = self.seen.number(buf, starts, ends)
        if len(new):
            self.seen_counts = np.concatenate([self.seen_counts, self.count_spans(buf, starts[new], ends[new])])
        return np.bincount(doc, minlength=n), np.bincount(doc, self.seen_counts[number], n).astype(np.int64)


_counters: dict[str, UnigramCounter] = {}


def _unigrams(token: str, shared) -> UnigramCounter:
    """The worker's counter, built once."""
    if token not in _counters:
        _counters.clear()
        _counters[token] = UnigramCounter(shared.value)
    return _counters[token]


def _counter(shared, token: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _unigrams(token, shared)
        for rows, buf, offs in pieces(batches, "_text"):
            found = [pa.array(x) for x in counter.count(buf, offs)]
            yield pa.RecordBatch.from_arrays(rows.columns[1:] + found, names=rows.schema.names[1:] + ["n_pretokens", "n_tokens"])

    return count


def token_counts(df: DataFrame, path: str, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_pretokens and n_tokens of each text, by the pieces of a rank file."""
    if clash := set(carry) & {"n_pretokens", "n_tokens"}:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: its size is fixed
    rows = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + ["n_pretokens bigint, n_tokens bigint"])
    return rows.mapInArrow(_counter(shared, uuid.uuid4().hex), schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})
