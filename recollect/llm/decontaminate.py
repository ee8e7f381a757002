"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items make one generalised suffix automaton over words.  Every
document streams its words through it; the automaton keeps the length of the longest
suffix of what has been read that occurs in some item.  When that length reaches the
window (13 words; all of a shorter item), the words behind are a hit.

The automaton is sent to the executors only up to ``block_words`` item words; a larger
benchmark is worked through in blocks of that size, each against all documents.  Hits
depend on nothing but the text, so those of the blocks are united per text (by its SHA-256)
and every row gets the hits of its text, whatever its id.

Defined results: null or empty text has no words, no hits and is not contaminated; items
without words are ignored; an item without an id has windows like any other, but no name to
report; items that repeat (same id or same text) each count by their id once; documents that repeat are independent rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recollect.shipping import ship
from recollect.llm.textbatch import pieces

WINDOW = 13
BLOCK_WORDS = 200_000

#: bytes.translate table: lower-cases A-Z and turns separators into blanks.
NORMAL = bytes(32 if (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences that reports windows of items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.window = window
        self.found: list[dict[int, set[str | None]]] = [{} for _ in self.next]  # by state: window size -> items
        for name, words in items:
            self._report(name, words)
        self.ending = [self._chain(s) for s in range(len(self.next))]

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for p's strings followed by word, made of q's shorter strings."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.next[last].get(word)) is not None:
            return self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, self.next[p][word])
        return state

    def step(self, state: int, size: int, word: bytes) -> tuple[int, int]:
        """The longest suffix of (what is matched + word) that occurs in an item."""
        while state and word not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if (q := self.next[state].get(word)) is not None:
            return q, size + 1
        return 0, 0

    def _report(self, name: str | None, words: list[bytes]) -> None:
        """Note the item at the states where its windows end."""
        k, state, size = min(self.window, len(words)), 0, 0
        for i, w in enumerate(words):
            state, size = self.step(state, size, w)
            if i + 1 >= k:
                at = state
                while self.length[self.link[at]] >= k:
                    at = self.link[at]
                self.found[at].setdefault(k, set()).add(name)

    def _chain(self, state: int) -> tuple[tuple[int, frozenset[str]], ...]:
        """The windows that are suffixes of a state's strings, longest first."""
        out = []
        while state > 0:
            out += [(k, frozenset(names)) for k, names in self.found[state].items()]
            state = self.link[state]
        return tuple(sorted(out, key=lambda x: -x[0]))

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal hit runs [start, end) of words, and the items whose windows occur."""
        following, links, lengths, ending = self.next, self.link, self.length, self.ending
        root = following[0]
        state = size = 0
        spans: list[list[int]] = []
        items: set[str] = set()
        for i, w in enumerate(words):
            if state:
                q = following[state].get(w)
                while q is None and state:
                    state = links[state]
                    size = lengths[state]
                    q = following[state].get(w)
            else:
                q = root.get(w)
            if q is None:
                size = 0
                continue
            state, size = q, size + 1
            if ending[state]:
                longest = 0
                for k, names in ending[state]:
                    if k <= size:
                        longest = longest or k
                        items |= names
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, items


_built: dict[tuple, SuffixAutomaton] = {}

RESULT = "n_words bigint, spans array<array<bigint>>, items array<string>"


def _automaton(token: str, shared, window: int) -> SuffixAutomaton:
    """The worker's automaton, built once."""
    if token not in _built:
        _built.clear()
        _built[token] = SuffixAutomaton([(i, normal_words(t)) for i, t in shared.value], window)
    return _built[token]


def _scanner(shared, window: int, token: str):
    """Scans the first column of each batch and passes the others on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, shared, window)
        for batch, _, _ in pieces(batches, "_text"):
            n_words, found = [], []
            for text in batch.column(0):
                words = normal_words(text.as_py())
                n_words.append(len(words))
                found.append(automaton.scan(words))
            arrays = [pa.array(n_words, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x - {None}) for _, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + arrays, names=batch.schema.names[1:] + ["n_words", "spans", "items"])

    return scan


def united(spans: Column) -> Column:
    """Spans [start, end) in any order, as maximal runs."""
    empty = F.array().cast("array<array<bigint>>")
    top = lambda done: F.element_at(done, -1)
    join = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(top(done)[0], F.greatest(top(done)[1], x[1]))))
    return F.aggregate(F.array_sort(spans), empty, lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))[1] >= x[0]), join(done, x)).otherwise(F.concat(done, F.array(x))))


def _blocks(benchmark: DataFrame, item: str, item_text: str, block_words: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    most_words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = int(most_words // block_words) + 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)] if n > 1 else [items]


def _scanned(documents: DataFrame, text: str, carry: list[str], block: DataFrame, window: int) -> DataFrame:
    """The carried columns with what one block of items finds, in one pass over the documents."""
    spark = documents.sparkSession
    ship(spark)
    rows = sorted(((r["item"], r["text"]) for r in block.toLocalIterator()), key=lambda r: (r[0] or "", r[1]))
    docs = documents.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {docs.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [RESULT])
    out = docs.mapInArrow(_scanner(spark.sparkContext.broadcast(rows), window, uuid.uuid4().hex), schema)
    return out.withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the words of the first column and passes the others on."""
    for batch in batches:
        n_words = pa.array([len(normal_words(text.as_py())) for text in batch.column(0)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], n_words], names=[*batch.schema.names[1:], "n_words"])


def text_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _text_hits(documents: DataFrame, text: str, blocks: list[DataFrame], window: int) -> DataFrame:
    """text_id, n_words, spans, items of every text with hits, from several blocks of items."""
    docs = documents.select(F.col(text).alias("text"), text_id(F.col(text)).alias("text_id"))
    found = [_scanned(docs, "text", ["text_id"], b, window).where(F.size("spans") > 0) for b in blocks]
    # sets: a text that many rows repeat leaves each task once
    out = reduce(DataFrame.unionByName, found).groupBy("text_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return out.withColumn("spans", united(F.col("spans")))


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of documents: key, n_words, spans (hit word runs [start, end)), items (names)."""
    if key in ("n_words", "spans", "items"):
        raise ValueError(f"the key is named like a result: {key}")
    blocks = _blocks(benchmark, item, item_text, block_words)
    if len(blocks) == 1:
        return _scanned(documents, text, [key], blocks[0], window)
    hits = _text_hits(documents, text, blocks, window).select(F.col("text_id").alias("_hit"), "spans", "items")
    docs = documents.select(F.col(text).alias("_text"), F.col(key).alias("_key"), text_id(F.col(text)).alias("_id"))
    rows = docs.mapInArrow(_counted, f"_key {docs.schema['_key'].dataType.simpleString()}, _id string, n_words bigint")
    empty = {"spans": "array<array<bigint>>", "items": "array<string>"}
    return rows.join(hits, rows["_id"] == hits["_hit"], "left").select(F.col("_key").alias(key), "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def is_contaminated(n_hit: Column, n_words: Column, least_share: int = 20) -> Column:
    """At least one word in ``least_share`` is a hit."""
    return (n_hit > 0) & (n_hit * least_share >= n_words)


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With one block of items this is one pass without a shuffle.
    """
    blocks = _blocks(benchmark, item, item_text, block_words)
    if len(blocks) == 1:
        names = {f"own_{k}": c for k, c in enumerate(documents.columns)}
        own = documents.select(*(F.col(c).alias(k) for k, c in names.items()), F.col(text).alias("text_to_scan"))
        hits = _scanned(own, "text_to_scan", list(names), blocks[0], window)
        return hits.where(~is_contaminated(hit_words(F.col("spans")), F.col("n_words"))).select(*(F.col(k).alias(c) for k, c in names.items()))
    hits = _text_hits(documents, text, blocks, window)
    bad = hits.where(is_contaminated(hit_words(F.col("spans")), F.col("n_words"))).select(F.col("text_id").alias("_bad"))
    return documents.join(bad, text_id(documents[text]) == bad["_bad"], "left_anti")
