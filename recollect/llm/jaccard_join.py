"""N-gram Jaccard join: documents whose shingle sets are similar, and their groups.

1. Every text becomes its set of distinct word shingles, as 64-bit hashes.  Texts with
   the same set are one class.
2. The shuffle counts in how many documents each shingle occurs.  A shingle that occurs
   in one document can't link it, so a document stays only if enough of its shingles
   occur elsewhere too.  The global order is rarest first.  With A >= ceil(t * n) shingles
   in common, two sets of any link share one of their first n - ceil(t * n) + 1 in that
   order, so documents meet by those few, and a boilerplate passage, however frequent,
   brings none together.
3. Classes that meet form units around the least class of each shingle.  In a unit the
   sets go into a trie by the global order, from its frequent end, so near copies share long
   paths; a query set walks down with its partial overlap and leaves a subtree when even all that
   remains can't reach the threshold, or when all its sets are already linked with it.
   A unit above ``UNIT_SHINGLES`` is dealt into parts by size class, and these into blocks:
   blocks are joined within, and the sets not linked with the unit's centre, as queries, with
   the other blocks of their own and of the neighbouring classes.
4. Links give components by propagating least labels, with a checkpoint every round.

No link is lost and nothing is capped or sampled; copies are never expanded into pairs.

Defined results: null or empty text, or text without words, has no shingles and is alone
in its component; fewer words than the shingle size are one shingle; rows with a null key
are counted, linked with nothing and have no component; equal texts are one class; every row
of the input is a row of the result, so rows that repeat whole (key and text) repeat with
the same values; a key must not have two texts (it would count as one document); extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm import packed
from recollect.llm.shared import folder as shared_folder
from recollect.shipping import ship
from recollect.llm.textbatch import LOWER, SPACE, byte_sums, mix, pieces, prefix_sums, ragged, span_hashes, window_hashes, words

SHINGLE = 5
#: The least similarity, in hundredths.
PERCENT = 75
#: Shared shingles of the sets that a task joins at once; a unit with more is dealt into blocks.
UNIT_SHINGLES = 1_000_000

SINGLES, MANY, HOLDERS, DOCUMENT = range(4)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n shares at least with any set it links to: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash), in order."""
    starts, ends, doc = words(buf, offs, SPACE)
    h = span_hashes(byte_sums(buf, LOWER), starts, ends)
    windows, whole = window_hashes(h, doc, size)
    first = np.searchsorted(doc, np.arange(len(offs)))
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    sums = prefix_sums(h, 1, 64)
    own = mix(span_hashes(sums, first[short], first[short] + count[short]) + count[short].astype(np.uint64))
    at = np.flatnonzero(whole)
    d, h = np.concatenate([doc[at], short]), np.concatenate([windows[at], own])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def _sender(size: int, n: int, back: int):
    """Shingles of one document in a task go as (hash, document); of more, as (hash, count) and a list that waits for the count."""

    def rows(d: np.ndarray, h: np.ndarray, task: int) -> list[tuple]:
        order = np.lexsort((d, h))
        d, h = d[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(h)))
        one, more = start[count == 1], start[count > 1]
        out = [(s, SINGLES, packed.pack_sorted(h[one][lo:hi]), packed.planes(d[one][lo:hi]), None) for s, lo, hi in packed.runs_of(packed.slots(h[one], n))]
        if len(more):
            times = count[count > 1]
            place = task.to_bytes(8, "big")
            out += [(s, MANY, packed.pack_sorted(h[more][lo:hi]), packed.planes(times[lo:hi].astype(np.uint32)), place) for s, lo, hi in packed.runs_of(packed.slots(h[more], n))]
            holders = d[ragged(more, times)]
            out.append((task % back, HOLDERS, packed.pack_sorted(h[more]), packed.planes(times.astype(np.uint32)) + packed.planes(holders), place))
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have = 0

        def handed() -> pa.RecordBatch:
            d, h = (np.concatenate(x) for x in zip(*held, strict=True))
            task = int(mix(np.array([d.astype(np.uint64).sum() + h.sum()], np.uint64))[0] >> np.uint64(1))
            return packed.packed_batch(rows(d, h, task))

        for batch, buf, offs in pieces(batches, "_text"):
            key = batch.column(1).to_numpy()
            d, h = shingle_sets(buf, offs, size)
            n_own = np.bincount(d, minlength=batch.num_rows)
            sums = np.zeros((2, batch.num_rows), np.uint64)
            if len(d):
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                sums[0, d[first]] = np.add.reduceat(mix(h), first)
                sums[1, d[first]] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
            same = mix(sums[0] ^ mix(sums[1] + n_own.astype(np.uint64)))
            cells = packed.planes(key), packed.planes(n_own.astype(np.int64)), packed.planes(same)
            yield packed.packed_batch([(int(key[0]) % back, DOCUMENT, *cells)])
            held.append((key[d], h))
            have += len(h)
            if have >= packed.GATHERED:
                yield handed()
                held, have = [], 0
        if have:
            yield handed()

    return send


#: owner: a document (kind SINGLES) or a task (kinds MANY and HOLDERS)
def _count(back: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: set[int] = set()
        cells = packed.gathered(packed.noted(batches, keys))
        for kind in (HOLDERS, DOCUMENT):
            if cells[kind]:
                yield packed.packed_batch([(*keys, kind, *x) for x in cells[kind]])
        one, more = cells[SINGLES], cells[MANY]
        if not one and not more:
            return
        parts = [packed.unpack_sorted(a) for a, _, _ in one] + [packed.unpack_sorted(a) for a, _, _ in more]
        h = np.concatenate(parts)
        owner = np.concatenate([packed.from_planes(b, np.int64) for _, b, _ in one] + [np.full(len(p), int.from_bytes(c, "big"), np.int64) for p, (_, _, c) in zip(parts[len(one) :], more, strict=True)])
        single = np.arange(len(h)) < sum(map(len, parts[: len(one)]))
        times = np.concatenate([np.ones(int(single.sum()), np.int64)] + [packed.from_planes(b, np.uint32).astype(np.int64) for _, b, _ in more])
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        total = np.add.reduceat(times[order], start)
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(start, len(h))))
        df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
        yield from told(h, owner, df, single & (df > 1), SINGLES)
        yield from told(h, owner, df, ~single, MANY)

    def told(h: np.ndarray, owner: np.ndarray, df: np.ndarray, which: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        h, owner, df = h[which], owner[which], df[which]
        slot = packed.slots(mix(owner.view(np.uint64)), back) if kind == SINGLES else owner % back
        order = np.lexsort((h, slot))
        yield packed.packed_batch([(s, kind, packed.pack_sorted(h[order[lo:hi]]), packed.planes(df[order[lo:hi]]), packed.planes(owner[order[lo:hi]])) for s, lo, hi in packed.runs_of(slot[order])])

    return count


def _counter(size: int):
    """The number of shingles of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in pieces(batches, "_text"):
            d, _ = shingle_sets(buf, offs, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(d, minlength=batch.num_rows).astype(np.int64))], names=["n_shingles"])

    return count


SETS = "key bigint, n bigint, same bigint, shared binary, df binary"


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, class, hashes and frequencies of shared shingles), in up to three rows of a document."""
    cells = packed.gathered(batches)

    def shared(d: np.ndarray, h: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(d, kind="stable")
        d, h, df = d[order], h[order], df[order]
        found = list(packed.runs_of(d))
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), none, none, pa.array([h[lo:hi].tobytes() for _, lo, hi in found], pa.binary()), pa.array([df[lo:hi].tobytes() for _, lo, hi in found], pa.binary())], names=["key", "n", "same", "shared", "df"])

    for a, b, c in cells[DOCUMENT]:
        key, n, same = packed.from_planes(a, np.int64), packed.from_planes(b, np.int64), packed.from_planes(c, np.int64)
        none = pa.nulls(len(key), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(same), none, none], names=["key", "n", "same", "shared", "df"])
    if cells[SINGLES]:
        h, df, d = (np.concatenate(x) for x in zip(*((packed.unpack_sorted(a), packed.from_planes(b, np.uint32), packed.from_planes(c, np.int64)) for a, b, c in cells[SINGLES]), strict=True))
        yield shared(d, h, df)
    counts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for a, b, c in cells[MANY]:
        h, df, task = packed.unpack_sorted(a), packed.from_planes(b, np.uint32), packed.from_planes(c, np.int64)
        for t in np.unique(task).tolist():
            counts.setdefault(t, []).append((h[task == t], df[task == t]))
    for a, b, c in cells[HOLDERS]:
        h = packed.unpack_sorted(a)
        times = packed.from_planes(b[: 4 * len(h)], np.uint32).astype(np.int64)
        d = packed.from_planes(b[4 * len(h) :], np.int64)
        known, df = (np.concatenate(x) for x in zip(*counts[int.from_bytes(c, "big")], strict=True))
        order = np.argsort(known)
        df = df[order][np.searchsorted(known[order], h)]
        yield shared(d, np.repeat(h, times), np.repeat(df, times))


def _ordered(percent: int):
    """Candidates' shared shingles, rarest first, and how many of those are the prefix; null for the others."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prefix = [], []
            for n, shared, df in zip(batch.column("n").to_pylist(), batch.column("shared").to_pylist(), batch.column("df").to_pylist(), strict=True):
                h, first = np.unique(np.frombuffer(b"".join(shared), np.uint64), return_index=True)
                f = np.frombuffer(b"".join(df), np.uint32)[first]
                own = n - len(h)  # shingles of this document alone come first
                need = n - int(least_overlap(n, percent)) + 1 - own
                if n == 0 or need <= 0:
                    sets.append(None)
                    prefix.append(None)
                    continue
                sets.append(h[np.lexsort((h, f))].tobytes())
                prefix.append(need)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("same"), pa.array(sets, pa.binary()), pa.array(prefix, pa.int64())], names=["key", "n", "same", "shared", "prefix"])

    return order


def document_sets(df: DataFrame, *, key: str, text: str, size: int, percent: int) -> DataFrame:
    """key, n, same (class), shared (of candidates: shared shingles, rarest first), prefix."""
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(key).isNotNull()).select(F.col(text).alias("_text"), F.col(key).cast("bigint").alias("_key"))
    n, back = packed.ranges(rows)
    sent = rows.mapInArrow(_sender(size, n, back), packed.PACKED)
    told = sent.groupBy("key").applyInArrow(_count(back), packed.PACKED)
    parts = told.groupBy("key").applyInArrow(_by_document, SETS)
    whole = parts.groupBy("key").agg(F.max("n").alias("n"), F.max("same").alias("same"), F.collect_list("shared").alias("shared"), F.collect_list("df").alias("df"))
    return whole.mapInArrow(_ordered(percent), "key bigint, n bigint, same bigint, shared binary, prefix bigint")


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of set sizes: sets that link are of the same or of neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.001 * 100 / percent)).astype(np.int64)


def _prefixes(percent: int):
    """(shingle, class, shared shingles, size class) for the first shingles of every set."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column("shared").to_pylist()]
            heads = [x[:p] for x, p in zip(sets, batch.column("prefix").to_pylist(), strict=True)]
            size = [len(x) for x in heads]
            of_set = [batch.column("same").to_numpy(), np.array([len(x) for x in sets], np.int64), size_class(batch.column("n").to_numpy(), percent)]
            arrays = [np.concatenate(heads or [np.zeros(0, np.int64)]), *(np.repeat(x, size) for x in of_set)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["shingle", "same", "weight", "size_class"])

    return prefixes


class Trie:
    """Sets as paths, most frequent shingle first, with edges of several shingles.

    A set that is added is first looked for: ``add`` returns the ids it links to, one for
    each group of sets that are linked already.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.root: dict[int, list] = {}
        self.sizes: list[int] = []  # the whole sets' sizes
        self.parent: list[int] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def put(self, path: tuple[int, ...], size: int) -> int:
        me = len(self.sizes)
        self.sizes.append(size)
        self.parent.append(me)
        self._insert(path, size, me)
        return me

    def add(self, path: tuple[int, ...], size: int) -> list[int]:
        found = self.linked(frozenset(path), size)
        me = self.put(path, size)
        for other in found:
            self.union(me, other)
        return found

    def linked(self, query: frozenset[int], size: int, group: int | None = None) -> list[int]:
        """Ids of sets that link to the query, without those already in its group."""
        out: list[int] = []
        p, floor = self.percent, -(-size * self.percent // 100)
        groups = {self.find(group)} if group is not None else set()
        # an edge: [shingles, as a set, children, ids that end here, least size of a set below, longest path from its start]
        stack = [(edge, 0) for edge in self.root.values()]
        while stack:
            (part, whole, children, ids, least, most), overlap = stack.pop()
            if not children and all(self.find(i) in groups for i in ids):
                continue
            # even if all that remains on either side agrees, and with the smallest set below
            bound = overlap + min(len(query) - overlap, most)
            if bound < floor or bound * (100 + p) < p * (size + least):
                continue
            overlap += len(query & whole) if len(part) > 1 else part[0] in query
            for i in ids:
                if overlap * (100 + p) >= p * (size + self.sizes[i]) and self.find(i) not in groups:
                    out.append(i)
                    groups.add(self.find(i))
            stack += [(edge, overlap) for edge in children.values()]
        return out

    def _insert(self, path: tuple[int, ...], size: int, me: int) -> None:
        children, at = self.root, 0
        while True:
            left = len(path) - at
            edge = children.get(path[at])
            if edge is None:
                part = path[at:]
                children[path[at]] = [part, frozenset(part), {}, [me], size, left]
                return
            part = edge[0]
            k = 1
            while k < len(part) and k < left and part[k] == path[at + k]:
                k += 1
            if k < len(part):  # split the edge
                low = [part[k:], frozenset(part[k:]), edge[2], edge[3], edge[4], edge[5] - k]
                edge[:4] = [part[:k], frozenset(part[:k]), {part[k]: low}, []]
            edge[4], edge[5] = min(edge[4], size), max(edge[5], left)
            at += k
            if at == len(path):
                edge[3].append(me)
                return
            children = edge[2]


def _paths(shared: pa.ChunkedArray) -> list[tuple[int, ...]]:
    """The sets as paths in the global order backwards: the most frequent shingle of the corpus first."""
    return [tuple(np.frombuffer(x, np.int64)[::-1].tolist()) for x in shared.to_pylist()]


def _unit_links(percent: int):
    """Links within each (centre, block), enough to connect what is linked."""

    def join(table: pa.Table) -> pa.Table:
        same = table.column("same").to_pylist()
        sizes = table.column("n").to_pylist()
        paths = _paths(table.column("shared"))
        order = sorted(range(len(same)), key=lambda i: (sizes[i], same[i]))
        trie, out = Trie(percent), []
        for k, i in enumerate(order):
            out += [(same[i], same[order[j]]) for j in trie.add(paths[i], sizes[i])]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return join


def _query_links(percent: int):
    """Links between the query sets and the other sets of each block, one for each component."""

    def join(table: pa.Table) -> pa.Table:
        same, sizes, query, component = (table.column(c).to_pylist() for c in ("same", "n", "query", "component"))
        paths = _paths(table.column("shared"))
        trie, names, of, out = Trie(percent), [], {}, []
        for i in range(len(same)):
            if not query[i]:
                trie.put(paths[i], sizes[i])
                trie.union(len(names), of.setdefault(component[i], len(names)))
                names.append(same[i])
        for i in range(len(same)):
            if query[i]:
                out += [(same[i], names[j]) for j in trie.linked(frozenset(paths[i]), sizes[i], of.get(component[i]))]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return join


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (a, b) reaches."""
    pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = pairs.join(labels, pairs["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        merged = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = merged.join(far, "label", "left").select("node", "old", F.least("label", "next").alias("label")).checkpoint()
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def links(sets: DataFrame, *, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """(a, b): links between classes that connect every two classes that are linked."""
    some = sets.where("shared is not null")
    prefix = some.select("same", "n", "shared", "prefix").mapInArrow(_prefixes(percent), "shingle bigint, same bigint, weight bigint, size_class bigint")
    centre = prefix.groupBy("shingle").agg(F.min("same").alias("centre"), F.max("same").alias("other")).where("centre <> other").select("shingle", "centre")
    met = prefix.join(centre, "shingle").select("centre", "same", "weight", "size_class").distinct()  # the centre meets itself, too
    one = some.groupBy("same").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    total = met.groupBy("centre").agg(F.sum("weight").alias("total"))
    # a large unit falls into parts by size class, and these into blocks; others are one part
    parted = met.join(total, "centre").withColumn("part", F.when(F.col("total") > unit_shingles, F.col("size_class")).otherwise(-1))
    blocks = parted.groupBy("centre", "part").agg(F.ceil(F.sum("weight") / unit_shingles).alias("blocks"))
    units = parted.join(blocks, ["centre", "part"]).withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks"))).select("centre", "same", "weight", "part", "blocks", "block").checkpoint()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    to = units.where("part >= 0").select("centre", F.col("part").alias("to"), "blocks").distinct()  # the parts of large units
    near = lambda rows: rows.drop("blocks").join(to, "centre").where("abs(part - to) <= 1")
    members = units.where("same <> centre or part < 0").select("centre", "same", "part", "block")
    centres = near(units.where("same = centre and part >= 0")).select("centre", "same", F.col("to").alias("part"), every("blocks").alias("block"))  # they stand in every block that can hold a link
    pair = "a bigint, b bigint"
    within = members.unionByName(centres).join(one, "same").groupBy("centre", "part", "block").applyInArrow(_unit_links(percent), pair)
    if units.where("part >= 0").limit(1).count() == 0:
        return within
    within = within.checkpoint()
    large = units.where("part >= 0").join(components(within).withColumnRenamed("node", "same"), "same", "left").withColumn("component", F.coalesce("component", "same"))
    middle = large.where("same = centre").select("centre", F.col("component").alias("middle"))
    rest = near(large.join(middle, "centre").where("component <> middle"))
    asks = rest.groupBy("centre", "to").agg(F.ceil(F.sum("weight") / unit_shingles).alias("asks"))
    asked = rest.join(asks, ["centre", "to"]).withColumn("ask", F.pmod(F.xxhash64("same", F.lit(1)), F.col("asks")))
    queries = asked.select("centre", "same", "component", "ask", "part", F.col("block").alias("own"), "to", every("blocks").alias("block"), F.lit(True).alias("query")).where("own <> block or part <> to")
    queries = queries.select("centre", "same", "component", "ask", F.col("to").alias("part"), "block", "query")
    others = large.where("same <> centre").join(asks.withColumnRenamed("to", "part"), ["centre", "part"]).select("centre", "same", "component", every("asks").alias("ask"), "part", "block", F.lit(False).alias("query"))
    across = queries.unionByName(others).join(one, "same").groupBy("centre", "part", "block", "ask").applyInArrow(_query_links(percent), pair)
    return within.union(across.checkpoint())


def similar_groups(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """key, n_shingles and component_id (the least key that links reach) of every document.

    ``key`` is a whole number that identifies a document.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "jaccard")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    document_sets(df, key=key, text=text, size=size, percent=percent).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    groups = components(links(sets, percent=percent, unit_shingles=unit_shingles))
    classes = sets.where("n > 0").groupBy("same").agg(F.min("key").alias("first"))
    whole = classes.join(groups, classes["same"] == groups["node"], "left").select("same", "first", F.coalesce("component", "same").alias("component"))
    # dealt again, so that Spark can split the join where a component has very many classes
    least = whole.groupBy("component").agg(F.min("first").alias("component_id")).repartition("component")
    named = whole.join(least, "component").select("same", "component_id")
    out = sets.select("key", "n", F.when(F.col("n") > 0, F.col("same")).alias("same")).join(named, "same", "left")
    result = out.select(F.col("key").alias("_known"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key))
    known = rows.join(result, rows[key] == result["_known"]).select(key, "n_shingles", "component_id")
    alone = df.where(F.col(key).isNull()).select(F.col(text).alias("_text")).mapInArrow(_counter(size), "n_shingles bigint")
    return known.unionByName(alone.select(F.lit(None).cast("bigint").alias(key), "n_shingles", F.lit(None).cast("bigint").alias("component_id")))
