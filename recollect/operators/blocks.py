"""A stored inverted index in compressed rows: posting blocks by range of terms, offsets, and top-k that leaves blocks unread.

Postings are sorted by term, document shard and id over all tasks; every slice of that order
is a folder.  A block has up to BLOCK postings of one term and shard: the first id, the gaps
to the next ones in as few bytes as they need, the weights, and the greatest weight.

A search works shard by shard.  Terms of a query come in the order of the most they can add;
a block is decoded only if a document that isn't known yet could still come in through it,
or one of the documents in its range could still rise to the k-th score so far.  Shards hold
documents of like length: terms weigh most in short documents, so the k-th score of the
first shard, where the others start from, closes most blocks of the longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from recollect.functions.scores import rounded
from recollect.operators.lexical import build_index, query_terms
from recollect.operators.ranking import top_k
from recollect.shipping import ship

BLOCK, SHARD_DOCUMENTS = 64, 65_536
#: Classes of document lengths, and the documents that a class has at least.
CLASSES, CLASS_DOCUMENTS = 64, 256
#: Scores are rounded before they are ranked; what is nearer than that to a bound is kept.
SLACK = 1e-7

BLOCKS = "term string, shard int, n int, first bigint, last bigint, most double, gaps binary, weights binary, slice int"
FOUND = "query_id bigint, id bigint, score double, postings bigint, decoded bigint"


def encode(ids: np.ndarray) -> bytes:
    """The gaps of sorted ids: a byte for the width, then the numbers."""
    gaps = np.diff(ids).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(gaps) or int(gaps.max()) < 1 << 8 * w)
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes()


def encode_all(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``encode`` of many runs ids[start:end], of which each begins where the one before ends; without a loop over them."""
    n = len(starts)
    gaps = np.diff(ids[starts[0] : ends[-1]], prepend=ids[starts[0]])
    gaps[starts - starts[0]] = 0  # a run's first id is stored apart
    gaps = gaps.astype(np.uint64)
    greatest = np.maximum.reduceat(gaps, starts - starts[0])
    width = np.select([greatest < 1 << 8, greatest < 1 << 16, greatest < 1 << 32], [1, 2, 4], 8)
    bounds = np.concatenate([[0], np.cumsum(1 + width * (ends - starts - 1))])
    out = np.zeros(bounds[-1], np.uint8)
    out[bounds[:-1]] = width
    run = np.repeat(np.arange(n), ends - starts)
    within = np.arange(len(gaps)) - (starts - starts[0])[run]
    for w in np.unique(width).tolist():
        chosen = np.flatnonzero((width[run] == w) & (within > 0))
        at = bounds[run[chosen]] + 1 + w * (within[chosen] - 1)
        out[at[:, None] + np.arange(w)] = gaps[chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])


def decode(first: int, gaps: bytes) -> np.ndarray:
    out = np.frombuffer(gaps, f"<u{gaps[0]}", offset=1).astype(np.int64)
    return first + np.concatenate([[0], np.cumsum(out)])


def _encoder(block: int):
    def rows(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Blocks of the table, and the rows that may go on in the next one."""
        n = table.num_rows
        term, shard = table["term"].combine_chunks(), table["shard"].to_numpy()
        new = np.ones(n, bool)
        new[1:] = (shard[1:] != shard[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        run = np.flatnonzero(new)
        within = np.arange(n) - run[np.cumsum(new) - 1]
        starts = np.flatnonzero(within % block == 0)
        stop = n if last or not n else int(starts[-1])  # the last block may not be full
        starts = starts[starts < stop]
        ends = np.append(starts[1:], stop)
        if not len(starts):
            return None, table
        ids, weights = table["id"].to_numpy(), table["weight"].to_numpy()
        edges = (8 * np.append(starts, stop)).astype(np.int32)
        slice_ = TaskContext.get().partitionId()
        columns = [
            term.take(pa.array(starts)),
            pa.array(shard[starts], pa.int32()),
            pa.array((ends - starts).astype(np.int32)),
            pa.array(ids[starts]),
            pa.array(ids[ends - 1]),
            pa.array(np.maximum.reduceat(weights[:stop], starts)),
            encode_all(ids, starts, ends),
            pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(weights[:stop], "<f8"))]),
            pa.array(np.full(len(starts), slice_, np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")]), table.slice(stop)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, held = rows(table if held is None else pa.concat_tables([held, table]), False)
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            yield rows(held, True)[0]

    return encoded


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    @property
    def slices(self) -> DataFrame:
        """slice, first_term, last_term, postings: one row for each slice."""
        return self.spark.read.parquet(f"{self.path}/slices")

    def postings(self, term: str) -> DataFrame:
        """id, weight of one term: only the slices that hold it are read (one, unless the term fills more)."""
        held = [r["slice"] for r in self.slices.where((F.col("first_term") <= term) & (F.col("last_term") >= term)).select("slice").collect()]
        read = self.spark.read.schema(BLOCKS).option("basePath", f"{self.path}/blocks")
        # the folders by name: a filter leaves the others out of the scan, but not out of the files that are listed
        rows = (read.parquet(*(f"{self.path}/blocks/slice={n}" for n in held)) if held else self.blocks.where("false")).where(F.col("term") == term)
        return rows.select("first", "gaps", "weights").mapInArrow(_decoded, "id bigint, weight double")

    def offsets(self) -> DataFrame:
        """term, term_id, df, first: terms in order and where their postings begin, from numbers within slices."""
        own = self.blocks.groupBy("slice", "term").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("slice").orderBy("term")) - F.col("n")
        placed = own.withColumn("before", before)
        # a term may go on in the next slices: it belongs to the first
        terms = placed.groupBy("term").agg(F.min(F.struct("slice", "before")).alias("at"), F.sum("n").alias("df")).select("term", "df", F.col("at.slice").alias("slice"), F.col("at.before").alias("before"))
        terms = terms.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy("term")))
        starts = terms.groupBy("slice").agg(F.count("*").alias("terms"))
        each = self.slices.select("slice", "postings").join(starts, "slice", "left")
        order = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
        bases = each.select("slice", F.coalesce(F.sum("postings").over(order), F.lit(0)).alias("postings_before"), F.coalesce(F.sum("terms").over(order), F.lit(0)).alias("terms_before"))
        return terms.join(bases, "slice").select("term", (F.col("terms_before") + F.col("place") - 1).cast("bigint").alias("term_id"), F.col("df").cast("bigint").alias("df"), (F.col("postings_before") + F.col("before")).cast("bigint").alias("first"))

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        asked = query_terms(queries)
        blocks = self.blocks.drop("slice").join(asked.select("term").distinct(), "term", "left_semi")
        terms = asked.join(blocks.select(F.col("shard").alias("part"), "term").distinct(), "term")

        def of(which: str, thresholds: DataFrame | None) -> DataFrame:
            rows = terms.where(f"part {which}")
            rows = rows.withColumn("least", F.lit(0.0)) if thresholds is None else rows.join(thresholds, "query_id", "left").fillna(0.0, ["least"])
            return rows.select("part", "query_id", "term", "times", "least").groupBy("part").cogroup(blocks.where(f"shard {which}").groupBy("shard")).applyInArrow(_pruned(k), FOUND)

        first = of("= 0", None)
        ranks = top_k(first.where("id is not null").select("query_id", "id", rounded(F.col("score")).alias("score")), ["query_id"], k)
        least = ranks.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        return first.unionByName(of("> 0", least))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best documents of every query, the same as by all postings: query_id, id, score, rank."""
        found = self._found(queries, k).where("id is not null").select("query_id", "id", rounded(F.col("score")).alias("score"))
        return top_k(found.where("score > 0"), ["query_id"], k)

    def work(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, postings, decoded: the postings of a query's terms, and those in blocks that its search decodes."""
        return self._found(queries, k).where("id is null").groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("decoded").alias("decoded"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, gaps, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(decode(first, gaps)), pa.array(np.frombuffer(weights, "<f8"))], names=["id", "weight"])


class _Term:
    """A term's blocks in one shard, in the order of ids."""

    def __init__(self, rows: list[tuple]):
        rows.sort()
        self.first, self.last, most, self.gaps, self.weights = zip(*rows, strict=True)
        self.starts, self.stops, self.most = np.array(self.first), np.array(self.last), np.array(most)
        self.postings = sum(len(w) for w in self.weights) // 8
        self.bound = float(self.most.max())


def best(terms: list[tuple[float, _Term]], k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores among which the k best are, and the number of decoded postings.  ``least``: a score that k documents are known to reach."""
    terms = sorted(terms, key=lambda t: -t[0] * t[1].bound)
    rest = np.append(np.cumsum([times * t.bound for times, t in terms][::-1])[::-1], 0.0)
    ids, scores = np.zeros(0, np.int64), np.zeros(0)
    decoded = 0
    for n, (times, term) in enumerate(terms):
        reach = times * term.most + rest[n + 1]
        fresh = reach >= least - SLACK
        lo, hi = np.searchsorted(ids, term.starts), np.searchsorted(ids, term.stops, "right")
        wanted = fresh.copy()
        some = np.flatnonzero(~fresh & (lo < hi))
        if len(some):
            highest = np.array([scores[a:b].max() for a, b in zip(lo[some].tolist(), hi[some].tolist(), strict=True)])
            wanted[some] = highest + reach[some] >= least - SLACK
        new_ids, new_scores = [ids], [scores]
        for b in np.flatnonzero(wanted).tolist():
            own, value = decode(term.first[b], term.gaps[b]), times * np.frombuffer(term.weights[b], "<f8")
            decoded += len(own)
            at = np.searchsorted(ids, own)
            known = np.append(ids, -1)[at] == own if len(ids) else np.zeros(len(own), bool)
            known &= at < len(ids)
            scores[at[known]] += value[known]
            if fresh[b]:
                new_ids.append(own[~known])
                new_scores.append(value[~known])
        if len(new_ids) > 1:
            ids, scores = np.concatenate(new_ids), np.concatenate(new_scores)
            order = np.argsort(ids)
            ids, scores = ids[order], scores[order]
        if len(scores) >= k:
            least = max(least, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        keep = scores + rest[n + 1] >= least - SLACK
        ids, scores = ids[keep], scores[keep]
    return ids, scores, decoded


def _pruned(k: int):
    def search(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        held: dict[str, list[tuple]] = {}
        for term, *row in zip(*(blocks[c].to_pylist() for c in ("term", "first", "last", "most", "gaps", "weights")), strict=True):
            held.setdefault(term, []).append(tuple(row))
        terms = {term: _Term(rows) for term, rows in held.items()}
        queries: dict[int, list] = {}
        least: dict[int, float] = {}
        for q, term, times, at in zip(*(asked[c].to_pylist() for c in ("query_id", "term", "times", "least")), strict=True):
            queries.setdefault(q, []).append((float(times), terms[term]))
            least[q] = at
        out: list[list] = [[], [], [], [], []]
        for q, own in queries.items():
            ids, scores, decoded = best(own, k, least[q])
            for column, values in zip(out, ([q] * (len(ids) + 1), [*ids.tolist(), None], [*scores.tolist(), None], [None] * len(ids) + [sum(t.postings for _, t in own)], [None] * len(ids) + [decoded]), strict=True):
                column += values
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return search


def length_class(length: Column, bounds: list[int]) -> Column:
    """How many of the bounds are below a length: a sum of comparisons, which Spark compiles (it doesn't compile a filter of an array)."""
    return sum((F.when(length > b, 1).otherwise(0) for b in bounds), F.lit(0))


def store_index(docs: DataFrame, path: str, *, block: int = BLOCK, shard_documents: int = SHARD_DOCUMENTS, class_documents: int = CLASS_DOCUMENTS) -> StoredIndex:
    """Write the index of docs (id, text) to a folder."""
    spark = docs.sparkSession
    ship(spark)
    index = build_index(docs)
    index.postings.select("term", F.col("id").cast("bigint").alias("id"), "length", "weight").write.parquet(f"{path}/postings")
    index.lengths.select("length").write.parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    n = lengths.count()
    classes = min(CLASSES, max(1, n // class_documents))
    shares = [k / classes for k in range(1, classes)]
    bounds = sorted(set(lengths.agg(F.percentile_approx("length", shares)).first()[0] or [])) if shares else []
    dealt = max(1, -(-n // ((len(bounds) + 1) * shard_documents)))
    shard = length_class(F.col("length"), bounds) * dealt + F.pmod(F.xxhash64("id"), F.lit(dealt))
    order = ["term", "shard", "id"]
    rows = spark.read.parquet(f"{path}/postings").select("term", shard.cast("int").alias("shard"), "id", "weight")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encoder(block), BLOCKS).write.partitionBy("slice").parquet(f"{path}/blocks")
    stored = StoredIndex(spark, path)
    stored.blocks.groupBy("slice").agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.sum("n").alias("postings")).write.parquet(f"{path}/slices")
    return stored
