"""Suffix-array dedup of byte strings that repeat anywhere in a corpus.

A string of ``length`` bytes holds ``length - GRAM + 1`` grams; its anchor is the first of
those with the least hash.  Equal strings have equal anchors at equal places, so a suffix
only needs comparing with suffixes of the same anchor, and the corpus's suffixes fall apart
into independent groups:

1. Tasks cut every text into runs of starts with one anchor and send a row for each: the
   gram's hash, a hash of the run's bytes (its context), and the place.  Contexts equal as
   a whole are copies; the first stands for all of them, and later ones of one task leave
   it as removals, so that no common context gathers in one place.
2. Where an anchor has several different contexts, their bytes are fetched from the texts.
   Each group's starts are put into suffix order (prefix tripling over ranks), with the
   common prefix of neighbours.  Longest-previous-factor values, from the previous and the
   next smaller position in that order, tell how long a match with an earlier place is;
   the same with places in reverse gives the longest match with a later place.
3. An anchor with more than ``most`` different contexts, such as the edge of a passage that
   very many documents quote, must not be gathered in one task.  Its starts fall into finer
   groups, one for each string of ``length`` bytes; Spark orders their places, and a place
   after the first has a previous factor of that length.

``keep="first"`` removes copies that start later (a larger key, or later in the same
document) and keeps the first; ``keep="none"`` removes every byte of a repeated string.
Strings are judged on the input, overlaps count, and matches never cross documents.
Equality of contexts (and of strings in 3) is that of two 64-bit hashes.

Defined results: null counts as empty; a text shorter than ``length`` keeps everything;
rows with a null key keep their text and count for no other; rows that repeat whole (key
and text) are one document, whose strings don't count as repeats of themselves; rows that
share a key but not the text are different documents; a text of any length is read in
segments; extra columns are ignored unless carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.llm.shared import folder
from recollect.shipping import ship
from recollect.llm.textbatch import byte_sums, mix, pieces, ragged, span_hashes, text_buffer

LENGTH = 400
GRAM = 64
#: Different contexts of an anchor that one task puts into suffix order.
MOST = 2000
#: Starts of one text that are worked on at once.
SEGMENT = 1 << 22
#: Rows that a task holds before it hands them on, and bytes of contexts put into order at once.
HELD, CHUNK = 500_000, 1 << 19

#: place: the text's version and the start; later: a copy of a context that comes earlier in the task; known: the context has copies.
RUNS = "gram bigint, context bigint, key bigint, place bigint, size int, anchor int, later boolean, known boolean"
CONTEXTS = "route bigint, gram bigint, key bigint, place bigint, known boolean, many boolean, context binary"
SPANS = "key bigint, place bigint, size bigint"


def anchored_runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: document, first start, bytes (to the last string's end), the anchor's place in them, gram hash, context hash."""
    grams = length - GRAM + 1
    count = np.maximum(np.diff(offs) - length + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = byte_sums(buf)
    at = np.arange(len(buf) - GRAM + 1)
    g = span_hashes(sums, at, at + GRAM)
    bits = np.uint64(max(1, len(g).bit_length()))
    ranked = (g >> bits << bits) | at.astype(np.uint64)  # the least hash, and the first of equals
    # the least of every run of `grams` values, from running minima of blocks of that size
    n = len(ranked)
    padded = np.full(-(-n // grams) * grams, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = ranked
    blocks = padded.reshape(-1, grams)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = ragged(offs[:-1], count)
    anchor = (np.minimum(behind[start], ahead[start + grams - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, anchor = start[first], start[last] + length, anchor[first]
    context = mix(span_hashes(sums, lo, hi) + (anchor - lo).astype(np.uint64))
    return doc[first], lo - offs[doc[first]], hi - lo, anchor - lo, g[anchor], context


def differs(*columns: np.ndarray) -> np.ndarray:
    """Of sorted entries, which differ from the one before them in any of the columns."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Runs of a task as rows: of equal contexts the first as itself, the others as later copies."""
    g, c, key, place, size, anchor, known = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, key, c, g))
    order = order[differs(g[order], c[order], key[order], place[order])]  # rows that repeat stand at the same place
    g, c, key, place, size, anchor, known = (x[order] for x in (g, c, key, place, size, anchor, known))
    first = differs(g, c)
    start = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    known = (np.logical_or.reduceat(known, start) | (np.diff(np.append(start, len(g))) > 1))[of]
    g, c = np.where(first, g, mix(key.view(np.uint64) ^ mix(place.view(np.uint64)))), np.where(first, c, np.uint64(0))  # later copies are dealt at random
    arrays = [pa.array(x.view(np.int64)) for x in (g, c, key, place)] + [pa.array(x.astype(np.int32)) for x in (size, anchor)] + [pa.array(~first), pa.array(known)]
    return pa.RecordBatch.from_arrays(arrays, names=["gram", "context", "key", "place", "size", "anchor", "later", "known"])


def _runs(length: int):
    """(text, key, version) -> RUNS"""
    segment = SEGMENT

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        have = 0
        for batch, buf, offs in pieces(batches, "_text"):
            key, version = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(buf) if len(offs) == 2 else 1, segment):
                some = buf[at : at + segment + length - 1] if len(offs) == 2 else buf
                part = some, np.array([0, len(some)]) if len(offs) == 2 else offs
                doc, start, size, anchor, g, c = anchored_runs(*part, length)
                held.append((g, c, key[doc], (version[doc] << 32) | (start + at), size, anchor, np.zeros(len(doc), bool)))
                have += len(doc)
                if have >= HELD:
                    yield combined(held)
                    held, have = [], 0
        if have:
            yield combined(held)

    return rows


def _strings(length: int):
    """CONTEXTS of large groups -> RUNS, one for each string."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        have = 0
        for batch in batches:
            batch = batch.filter(batch.column("many"))
            for key, place, known, context in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "known", "context")), strict=True):
                at = np.arange(len(context) - length + 1)
                buf = np.frombuffer(context, np.uint8)
                g = span_hashes(byte_sums(buf), at, at + length)
                c = span_hashes(byte_sums(buf[::-1]), at[::-1], at[::-1] + length)  # the same bytes read backwards
                held.append((g, c, np.full(len(at), key), place + at, np.full(len(at), length), at * 0, np.full(len(at), known)))
                have += len(at)
                if have >= HELD:
                    yield combined(held)
                    held, have = [], 0
        if have:
            yield combined(held)

    return rows


def judged(runs: DataFrame, keep: str) -> DataFrame:
    """gram, key, place, size, anchor, known; first: the first of its context; gone: a string that goes as a whole.

    A place that two tasks have read (repeated rows) counts once.
    """
    same = Window.partitionBy("gram", "context")
    order = same.orderBy("key", "place")
    place = F.struct("key", "place")
    rows = runs.select("gram", "key", "place", "size", "anchor", F.row_number().over(order).alias("number"), (F.col("later") | (F.rank().over(order) > 1)).alias("copy"), (F.max("known").over(same) | (F.max(place).over(same) > place)).alias("known"))
    first = (F.col("number") == 1) & ~F.col("copy")
    gone = F.col("copy") | F.col("known") if keep == "none" else F.col("copy")
    return rows.select("gram", "key", "place", "size", "anchor", "known", first.alias("first"), gone.alias("gone")).where("first or gone")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ..., asks) -> CONTEXTS: the bytes that are asked for."""
    for batch, buf, offs in pieces(batches, "_text"):
        data = buf.data
        asks = batch.column(batch.num_columns - 1)
        sizes = np.diff(asks.offsets.to_numpy())
        g, place, size, known, many = (x.to_numpy(zero_copy_only=False) for x in asks.flatten().flatten())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        key = batch.column("_key").to_numpy()[row]
        begin = offs[row] + (place & 0xFFFFFFFF)
        route = np.where(many, mix(key.view(np.uint64) ^ mix(place.view(np.uint64))).view(np.int64), g)  # large groups are dealt by place
        context = pa.array([data[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(g), pa.array(key), pa.array(place), pa.array(known), pa.array(many), context], names=["route", "gram", "key", "place", "known", "many", "context"])


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of values."""
    order = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(differs(x[order])) - 1
    return rank


def folded(parts: Sequence[np.ndarray]) -> np.ndarray:
    """One number for each tuple of ranks, in the tuples' order."""
    out = parts[0].astype(np.uint64)
    for part in parts[1:]:
        top = int(part.max()) + 1
        if (int(out.max()) + 1) * top >= 1 << 64:
            out = dense(out).astype(np.uint64)
        out = out * np.uint64(top) + part.astype(np.uint64)
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of starts within their groups, by up to ``length`` bytes, and the common prefix of each with the one before it.

    At least ``length`` bytes of its own follow every start, and ``length`` is 8 or more.  Ranks of 8 bytes give those of
    24, 72, ... and ranks of two or three overlapping pieces the order.  Ranks of ever smaller
    pieces, then bytes, give the common prefixes.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    ranks = [dense(word)]
    size = 8
    reach = lambda rank, by: np.concatenate([rank[by:], np.zeros(by, np.int64)])[:n]
    while 3 * size <= length:
        ranks.append(dense(folded([ranks[-1], reach(ranks[-1], size), reach(ranks[-1], 2 * size)])))
        size *= 3
    at = sorted({min(k * size, length - size) for k in range(-(-length // size))})
    order = np.argsort(folded([group, *(ranks[-1][starts + k] for k in at)]))
    a, b = starts[order[1:]], starts[order[:-1]]
    common = np.zeros(len(a), np.int64)
    mates = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    a, b, own = a[mates], b[mates], np.zeros(len(mates), np.int64)
    for rank in reversed(ranks):
        for _ in range(2 + (size * 3 <= length)):
            same = np.flatnonzero(own + size <= length)
            same = same[rank[a[same] + own[same]] == rank[b[same] + own[same]]]
            own[same] += size
            if not len(same):
                break
        size //= 3
    left = np.flatnonzero(own < length)
    apart = word[np.minimum(a[left] + own[left], n - 1)] ^ word[np.minimum(b[left] + own[left], n - 1)]
    for k in range(1, 8):  # whole equal bytes ahead of the first that differs
        own[left] += (apart >> np.uint64(8 * (8 - k)) == 0) & (own[left] < length)
    common[mates] = own
    return order, np.concatenate([[0], common]) if len(order) else common


def _toward(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry in suffix order its common prefix with the nearest one before it whose position is smaller.

    Every entry points to the one before it; as long as that has a larger position, the entry
    takes over where that one points, and the least common prefix on the way.
    """
    to, least = np.arange(len(position)) - 1, shared.copy()
    active = np.flatnonzero(to >= 0)
    while True:
        active = active[(least[active] > 0) & (to[active] >= 0)]
        active = active[position[to[active]] > position[active]]
        if not len(active):
            return np.where(to >= 0, least, 0)
        via = to[active]
        to[active], least[active] = to[via], np.minimum(least[active], least[via])


def longest_previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry in suffix order its longest common prefix with any smaller position.

    ``shared`` is the common prefix of each entry with the one before it.  The longest is that
    with the previous or with the next smaller position in suffix order.
    """
    backwards = np.concatenate([[0], shared[:0:-1]]) if len(shared) else shared
    return np.maximum(_toward(position, shared), _toward(position[::-1], backwards)[::-1])


def repeated_starts(contexts: Sequence[bytes], group: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Context number and offset of the starts that match elsewhere (keep none) or at an earlier place (keep first) of their group.

    Contexts stand in the order of their places, group after group.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    starts = ragged(begin, count)
    of = np.repeat(np.arange(len(sizes)), count)
    order, shared = suffix_array(np.frombuffer(b"".join(contexts), np.uint8), starts, group[of], length)
    longest = longest_previous_factors(order, shared)
    if keep == "none":
        longest = np.maximum(longest, longest_previous_factors(-order, shared))
    hits = np.sort(order[longest >= length])
    return of[hits], starts[hits] - begin[of[hits]]


def _matched(length: int, keep: str):
    """CONTEXTS, sorted by group and place -> SPANS"""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        group = np.cumsum(differs(np.array([r[0] for r in rows], np.int64))) - 1
        of, at = repeated_starts([r[4] for r in rows], group, length, keep)
        key, place, known = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        if keep == "none":  # copies go as a whole already
            of, at = of[~known[of]], at[~known[of]]
        first = np.flatnonzero(differs(of, at - np.arange(len(at))))
        last = np.append(first[1:], len(at)) - 1
        arrays = [key[of[first]], place[of[first]] + at[first], at[last] - at[first] + length] if len(at) else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["key", "place", "size"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        have = 0
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("many")))
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "place", "known", "context")), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # rows that repeat answer alike
                if have >= CHUNK and row[0] != held[-1][0]:
                    yield spans(held)
                    held, have = [], 0
                held.append(row)
                have += len(row[4])
        if held:
            yield spans(held)

    return matched


def _remover(as_text: bool):
    """(text, known key, ..., spans) -> the carried columns, n_bytes, removed, kept"""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in pieces(batches, "_text"):
            data, offs = buf.data, offs.tolist()
            sizes, removed, kept = [], [], []
            for row, (has_key, cell) in enumerate(zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1), strict=True)):
                text = data[offs[row] : offs[row + 1]]
                runs: list[list[int]] = []
                if has_key and cell.is_valid:
                    place, size = (x.to_numpy() for x in cell.values.flatten())
                    at = place & 0xFFFFFFFF
                    for k in np.argsort(at, kind="stable").tolist():
                        lo, hi = int(at[k]), int(at[k] + size[k])
                        if runs and lo <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], hi)
                        else:
                            runs.append([lo, hi])
                parts, begin = [], 0
                for lo, hi in runs:
                    parts.append(text[begin:lo])
                    begin = hi
                sizes.append(len(text))
                removed.append(runs)
                left = b"".join([*parts, text[begin:]])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(batch.columns[4:-1] + arrays, names=batch.schema.names[4:-1] + ["n_bytes", "removed", "kept"])

    return remove


def by_document(places: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row per document with its places as a list: no more of them than its text has starts."""
    return places.groupBy(F.col("key").alias("_of"), F.shiftright("place", 32).alias("_of_version")).agg(F.collect_list(F.struct(*columns)).alias(name))


def repeated_spans(docs: DataFrame, *, length: int, keep: str, most: int) -> DataFrame:
    """SPANS of docs (_text, _has_key, _key, _version, ...)."""
    if length < GRAM:
        raise ValueError(f"length is at least {GRAM}")
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    spark = docs.sparkSession
    ship(spark)
    runs = docs.where("_has_key").select("_text", "_key", "_version").mapInArrow(_runs(length), RUNS)
    table = f"{folder(spark, 'suffixes')}/runs"
    judged(runs, keep).write.parquet(table)
    all_runs = spark.read.parquet(table)
    first = all_runs.where("first")
    groups = first.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("known").alias("all_known")).where("contexts > 1")
    if keep == "none":
        groups = groups.where("not all_known")
    asked = first.join(groups.select("gram", (F.col("contexts") > most).alias("many")), "gram").select("key", "gram", "place", "size", "known", "many")
    asks = by_document(asked, "_asks", "gram", "place", "size", "known", "many")
    contexts = with_places(docs, asks, "inner").mapInArrow(_contexts, CONTEXTS).repartition("route")
    # both read the same shuffle; groups above `most` are told apart only there
    small = contexts.sortWithinPartitions("gram", "key", "place").mapInArrow(_matched(length, keep), SPANS)
    large = judged(contexts.mapInArrow(_strings(length), RUNS), keep)
    gone = [x.where("gone").select("key", "place", F.col("size").cast("bigint").alias("size")) for x in (all_runs, large)]
    return small.unionByName(gone[0]).unionByName(gone[1])


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """All columns of docs, whatever is read of them, so that every join shares one shuffle of the texts."""
    joined = docs.join(places.hint("shuffle_hash"), (docs["_key"] == places["_of"]) & (docs["_version"] == places["_of_version"]), how)
    return joined.select(*docs.columns, places.columns[-1])


def version(text: Column) -> Column:
    """Tells texts of one key apart: 31 bits of a hash."""
    return F.abs(F.xxhash64(text) % (1 << 31))


def without_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "first", most: int = MOST, carry: Sequence[str] = ("doc_id",), as_text: bool = False) -> DataFrame:
    """The carried columns, n_bytes, removed (maximal byte runs [start, end)) and kept (the other bytes).

    ``key`` is a whole number that orders the documents.  With ``as_text`` kept is a string,
    without characters of which only a part is left.  The runs of step 1 are found and written
    to the shared folder when this is called; all else is left to the result's own job.
    """
    if clash := set(carry) & {"n_bytes", "removed", "kept"}:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    number = F.col(key).cast("bigint")
    docs = df.select(F.col(text).alias("_text"), number.isNotNull().alias("_has_key"), F.coalesce(number, F.lit(0).cast("bigint")).alias("_key"), version(F.col(text)).alias("_version"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    spans = by_document(repeated_spans(docs, length=length, keep=keep, most=most), "_spans", "place", "size")
    both = with_places(docs, spans, "left")
    schema = ", ".join([f"_{k} {docs.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [f"n_bytes bigint, removed array<array<bigint>>, kept {'string' if as_text else 'binary'}"])
    return both.mapInArrow(_remover(as_text), schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})
