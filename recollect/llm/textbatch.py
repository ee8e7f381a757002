"""Numpy views of the text in Arrow batches: bytes, characters, words and their hashes.

A batch of texts is one byte buffer with document offsets.  Words and word windows get
polynomial (Rabin-Karp) hashes from running sums, so the cost per byte is a few vector
operations and no Python object is made per word.  The polynomials are over the field of
2**61 - 1 elements: two different strings of n letters have one hash for at most n of the
bases.  (Modulo 2**64 there are strings, such as the Thue-Morse words, that have one hash
for every base.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once in a task (a single longer document is one piece).
PIECE_BYTES = 1 << 20

_U = np.uint64
PRIME = (1 << 61) - 1
_P = _U(PRIME)
_LOW31, _LOW30, _LOW32 = _U((1 << 31) - 1), _U((1 << 30) - 1), _U((1 << 32) - 1)
_rng = np.random.Generator(np.random.PCG64(0x5EED))
#: The bases of letters and of words.
_BASES = tuple(int(x) for x in _rng.integers(1 << 60, PRIME, 2))
_powers: dict[tuple[int, bool], np.ndarray] = {}

#: ``[\x20\x09-\x0D]`` separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` separates words once A-Z are lower-cased.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Everything but ASCII letters (either case) and non-ASCII bytes.
NON_LETTER = np.zeros(256, bool)
NON_LETTER[[c for c in range(128) if not chr(c).isalpha()]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = ah * bl + al * bh
    return _reduced((ah * bh << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + al * bl)


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo the prime."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, PRIME) if inverse else _BASES[which]
        have, most = np.ones(1, np.uint64), max(n, PIECE_BYTES + 1024)
        while len(have) < most:
            have = np.concatenate([have, _times(have, np.array(pow(base, len(have), PRIME), np.uint64))])[:most]
        if n <= 4 * PIECE_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (UTF-8) or binary column and its offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most max_bytes of text (or one row), with their bytes and offsets."""
    for batch in batches:
        buf, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def documents_of(offs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The document that holds each place."""
    return np.searchsorted(offs, places, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run without separators."""
    return runs(~separator[buf], offs)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of True within a document."""
    n = len(inside)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, documents_of(offs, starts)


@dataclass
class Sums:
    """Running sums, modulo 2**64, of the low and the high halves of letter * base**place.

    Differences over at most ``longest`` places are exact.
    """

    low: np.ndarray
    high: np.ndarray
    longest: int
    which: int


def prefix_sums(values: np.ndarray, which: int, bits: int) -> Sums:
    """Running sums for letters of so many bits, or for hashes (64)."""
    power = powers(which, False, len(values))
    if bits <= 24:
        low, high, longest = values * (power & _LOW32), values * (power >> _U(32)), 1 << (32 - bits)
    else:
        part = _times(_reduced(values), power)
        low, high, longest = part & _LOW32, part >> _U(32), 1 << 32
    out = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(low, out=out[0, 1:])
    np.cumsum(high, out=out[1, 1:])
    return Sums(out[0], out[1], longest, which)


def byte_sums(buf: np.ndarray, fold: np.ndarray | None = None) -> Sums:
    return prefix_sums((buf if fold is None else fold[buf]).astype(np.uint64) + _U(1), 0, 9)


def span_hashes(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's content, the same wherever the span stands."""
    inverse = powers(sums.which, True, len(sums.low))[starts]
    total = np.zeros(len(starts), np.uint64)
    while True:
        to = np.minimum(ends, starts + sums.longest)
        high = _reduced(sums.high[to] - sums.high[starts])
        # times 2**32, as 2**61 is 1
        total = _reduced(total + _reduced(sums.low[to] - sums.low[starts]) + ((high << _U(32)) & _P) + (high >> _U(29)))
        if np.array_equal(to, ends):
            return mix(_times(total, inverse))
        starts = to


def window_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words for each first word, and whether all k are of one document."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(m)
    return span_hashes(prefix_sums(hashes, 1, 64), at, at + k), doc[k - 1 :] == doc[:m]


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal size have the same bytes."""
    differ = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.cumsum(a[ragged(a_starts, sizes)] != b[ragged(b_starts, sizes)], out=differ[1:])
    ends = np.cumsum(sizes)
    return differ[ends] == differ[ends - sizes]


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contents by hash and bytes: their hashes, one span of each, and which each span has."""
    size = ends - starts
    hashes, first, which = np.unique(span_hashes(byte_sums(buf), starts, ends), return_index=True, return_inverse=True)
    like = first[which]
    equal = size == size[like]
    some = np.flatnonzero(equal & (like != np.arange(len(starts))))
    equal[some] = same_bytes(buf, starts[some], buf, starts[like[some]], size[some])
    if not equal.all():  # one hash, other bytes
        others: dict[bytes, int] = {}
        found, theirs = [], []
        for k in np.flatnonzero(~equal).tolist():
            data = buf[starts[k] : ends[k]].tobytes()
            if data not in others:
                others[data] = len(hashes) + len(others)
                found.append(k)
                theirs.append(hashes[which[k]])
            which[k] = others[data]
        hashes, first = np.append(hashes, np.array(theirs, np.uint64)), np.append(first, found)
    return hashes, first, which


class SpanTable:
    """Numbers for byte strings, in the order in which they came: found by hash, told equal by their bytes."""

    def __init__(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.bytes = np.zeros(0, np.uint8)
        self.begin = self.size = np.zeros(0, np.int64)  # by number

    def __len__(self) -> int:
        return len(self.size)

    def number(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each span's number, and a span for each of the numbers that are new."""
        hashes, first, which = distinct_spans(buf, starts, ends)
        size = (ends - starts)[first]
        out = np.full(len(first), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.numbers[at]
            some = np.flatnonzero((self.hashes[at] == hashes) & (self.size[known] == size))
            some = some[same_bytes(self.bytes, self.begin[known[some]], buf, starts[first[some]], size[some])]
            out[some] = known[some]
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = len(self) + np.arange(len(new))
            added, one = np.unique(hashes[new], return_index=True)
            at = np.searchsorted(self.hashes, added)
            free = np.append(self.hashes, _U(0))[at] != added if len(self.hashes) else np.ones(len(added), bool)
            free |= at == len(self.hashes)
            self.hashes = np.insert(self.hashes, at[free], added[free])
            self.numbers = np.insert(self.numbers, at[free], out[new[one[free]]])
            self.begin = np.concatenate([self.begin, len(self.bytes) + np.cumsum(size[new]) - size[new]])
            self.size = np.concatenate([self.size, size[new]])
            self.bytes = np.concatenate([self.bytes, buf[ragged(starts[first[new]], size[new])]])
        return out[which], first[new]


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte where each begins (with the end, one longer)."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    ends = np.append(at, len(buf))
    cp = buf[at].astype(np.uint32)
    size = np.diff(ends)
    for k, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        if len(some := np.flatnonzero(size == k)):
            p = at[some]
            value = (buf[p] & mask).astype(np.uint32)
            for j in range(1, k):
                value = (value << np.uint32(6)) | (buf[p + j] & 0x3F)
            cp[some] = value
    return cp, ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + size), one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
