"""Nearest neighbours of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.functions.scores import rounded
from recollect.functions.vectors import similarity
from recollect.operators.ranking import top_k
from recollect.shipping import ship

#: Up to so many query vectors go to all tasks at once.  More are dealt into blocks, and vectors into slices.
QUERY_BLOCK, GRID_QUERIES, GRID_VECTORS = 2_048, 8_192, 32_768
#: Queries of a block that are compared with a slice at once.
STEP = 128

FOUND = "query_id bigint, id bigint, d2 double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _pairs(ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    """All pairs that could be among the k nearest of a query after rounding."""
    far = np.maximum((matrix**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * matrix @ vectors.T, 0.0)
    n = min(k, far.shape[1])
    limit = np.partition(far, n - 1, axis=1)[:, n - 1 : n] + 1e-7
    q, d = np.nonzero(far <= limit)
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[d]), pa.array(((matrix[q] - vectors[d]) ** 2).sum(1))], names=["query_id", "id", "d2"])


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pairs(ids, matrix, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)

    return nearest


def _slice_nearest(k: int):
    def nearest(asked: pa.Table, held: pa.Table) -> pa.Table:
        """A block of queries (query_id, asked) against a slice of vectors (id, embedding)."""
        out = [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "d2"])]
        if asked.num_rows and held.num_rows:
            ids, matrix = asked["query_id"].to_numpy(), _matrix(asked["asked"].combine_chunks())
            own, vectors = held["id"].to_numpy(), _matrix(held["embedding"].combine_chunks())
            out += [_pairs(ids[i : i + STEP], matrix[i : i + STEP], own, vectors, k) for i in range(0, len(ids), STEP)]
        return pa.Table.from_batches(out)

    return nearest


def _by_grid(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Every block of queries meets every slice of vectors in a task of bounded size; nothing goes through the driver."""
    count = lambda df, at_most, name: df.agg(F.greatest(F.ceil(F.count("*") / at_most), F.lit(1)).cast("bigint").alias(name))
    sizes = F.broadcast(count(asked, GRID_QUERIES, "blocks").crossJoin(count(rows, GRID_VECTORS, "slices")))  # one row
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = asked.crossJoin(sizes).select("query_id", F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), each("slices").alias("slice"))
    held = rows.crossJoin(sizes).select("id", "embedding", each("blocks").alias("block"), F.pmod(F.xxhash64("id"), "slices").alias("slice"))
    return dealt.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInArrow(_slice_nearest(k), FOUND)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``vectors`` (id, embedding) to every query (query_id, embedding), exactly: score 1 / (1 + squared distance).

    Up to QUERY_BLOCK queries go to all tasks, and every batch keeps its k nearest of each; more of them
    meet the vectors in a grid of blocks and slices.  Rows without an embedding aren't found and find nothing.
    """
    ship(vectors.sparkSession)
    rows = vectors.where("embedding is not null").select(F.col("id").cast("bigint").alias("id"), "embedding")
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) > QUERY_BLOCK:
        found = _by_grid(asked, rows, k)
    elif few:
        found = rows.mapInArrow(_nearest(np.array([r["query_id"] for r in few], np.int64), np.array([r["embedding"] for r in few], np.float64), k), FOUND)
    else:
        found = rows.where("false").select(F.lit(0).cast("bigint").alias("query_id"), "id", F.lit(0.0).alias("d2"))
    return top_k(found.select("query_id", "id", rounded(similarity(F.col("d2"))).alias("score")), ["query_id"], k)
