"""A Merkle manifest of a dataset: one tree a part, the parts' peaks under one root, a proof for every row.

Leaves are sorted by Spark over all rows and written with their places.  Every BLOCK
consecutive leaves of a part are one group, which a task reduces to the block's node: the
blocks' nodes, a thousandth of the leaves, are the top tree.  The driver builds it where it
has at most TOP nodes and broadcasts each block's path to the peak; a larger one is reduced
by blocks once more, and its paths are joined.  Executors put the paths of rows together
and fold them, as column expressions.

In every tree each 2 consecutive nodes become the digest of both digests' hex text; a last
node without neighbour becomes the digest of itself.  A lone leaf is its tree's peak.

A path is an array of steps, leaf first: ``l`` and a digest where the neighbour stands to
the left, ``r`` and a digest to the right, nothing where there is none.

Defined results: null parts are a part of their own, before the others; of rows with equal
keys (null keys come first) the order is that of their leaves, so repeated rows take
neighbouring places and any of them may be the first; null fields have a mark that no value
has; empty and very long texts are texts; an empty table has no rows; carried columns keep
their values, and one that is named like a result is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from recollect.llm.shared import folder
from recollect.shipping import ship

#: Leaves that a task reduces at once, and nodes of which the driver builds the top.
BLOCK, TOP = 1 << 10, 1 << 14
RESULTS = ("part", "place", "leaf", "peak", "root", "path")


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: each field is ``-`` if null, else its UTF-8 size, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(node: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("l"), F.concat(other, node)).when(s.startswith("r"), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The neighbours' digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def _parents(nodes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(nodes[k : k + 2]).encode()).hexdigest() for k in range(0, len(nodes), 2)]


def reduced(nodes: list[str], levels: int | None = None) -> tuple[str, list[list[str]]]:
    """The peak of consecutive nodes and every node's path to it; ``levels``: as many, and not until one is left."""
    paths: list[list[str]] = [[] for _ in nodes]
    level = 0
    while level < levels if levels is not None else len(nodes) > 1:
        for k, path in enumerate(paths):
            at = k >> level
            path.append("" if at ^ 1 >= len(nodes) else ("l" if at & 1 else "r") + nodes[at ^ 1])
        nodes, level = _parents(nodes), level + 1
    return nodes[0], paths


def _levels(n: int, block: int) -> int | None:
    """A block below others has all its levels, even if it is short; a part of one block ends at its peak."""
    return block.bit_length() - 1 if n > block else None


def _block_nodes(block: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("_place")
        levels = _levels(table["_n"][0].as_py(), block)
        nodes = table["_node"].to_pylist()
        level = 0
        while level < levels if levels is not None else len(nodes) > 1:
            nodes, level = _parents(nodes), level + 1
        yield pa.RecordBatch.from_pydict({"_part": table["_part"][:1].combine_chunks(), "_place": pa.array([table["_place"][0].as_py() // block]), "_n": pa.array([-(-table["_n"][0].as_py() // block)]), "_node": pa.array(nodes)})

    return reduce


def _block_paths(block: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("_place")
        _, paths = reduced(table["_node"].to_pylist(), _levels(table["_n"][0].as_py(), block))
        for batch in table.append_column("_path", pa.array(paths, pa.list_(pa.string()))).to_batches():
            yield batch

    return reduce


def _local_paths(rows: list) -> list[tuple]:
    """(part, place, path, peak) of nodes on the driver."""
    parts: dict[str, list] = {}
    for r in rows:
        parts.setdefault(r["_part"], []).append((r["_place"], r["_node"]))
    out = []
    for part, own in parts.items():
        own.sort()
        peak, paths = reduced([node for _, node in own])
        out += [(part, place, path, peak) for (place, _), path in zip(own, paths, strict=True)]
    return out


def _paths(nodes: DataFrame, shared: str, block: int, top: int) -> DataFrame:
    """nodes (_part, _place, _n: how many the part has, _node) -> _part, _place, _up (the path to the part's peak), _peak."""
    spark = nodes.sparkSession
    if len(few := nodes.limit(top + 1).collect()) <= top:  # a bounded number of digests
        return F.broadcast(spark.createDataFrame(_local_paths(few), "_part string, _place bigint, _up array<string>, _peak string"))
    alone = nodes.where("_n = 1").select("_part", "_place", F.array().cast("array<string>").alias("_up"), F.col("_node").alias("_peak"))
    own, blocks = _by_blocks(nodes.where("_n > 1"), shared, block)
    return alone.unionByName(_above(own, _paths(blocks, shared, block, top)).select("_part", "_place", "_up", "_peak"))


def _by_blocks(nodes: DataFrame, shared: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``_block`` and ``_path`` (within it), and the blocks' nodes, which are written."""
    keyed = nodes.withColumn("_block", F.floor(F.col("_place") / block))
    target = f"{shared}/nodes-{uuid.uuid4().hex}"
    keyed.select("_part", "_block", "_place", "_n", "_node").groupBy("_part", "_block").applyInArrow(_block_nodes(block), "_part string, _place bigint, _n bigint, _node string").write.parquet(target)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", _path array<string>"
    return keyed.groupBy("_part", "_block").applyInArrow(_block_paths(block), schema), nodes.sparkSession.read.parquet(target)


def _above(own: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes with ``_up``: the path within the block, then that of the block's node; and what else upper has."""
    upper = upper.withColumnsRenamed({"_part": "_part2", "_place": "_place2", "_up": "_rest"})
    both = own.join(upper, (F.col("_part") == F.col("_part2")) & (F.col("_block") == F.col("_place2")))
    return both.withColumn("_up", F.concat("_path", "_rest")).drop("_path", "_rest", "_part2", "_place2", "_block")


def _with_root(upper: DataFrame, shared: str, block: int, top: int) -> DataFrame:
    """Paths to the parts' peaks, made longer up to the root."""
    spark = upper.sparkSession
    peaks = upper.where("_place = 0").select("_part", F.col("_peak").alias("_node"))
    few = peaks.limit(top + 1).collect()
    if len(few) <= top:
        few.sort(key=lambda r: r["_part"].encode())
        found = _local_paths([{"_part": "", "_place": k, "_node": r["_node"]} for k, r in enumerate(few)])
        roots = F.broadcast(spark.createDataFrame([(few[place]["_part"], path, root) for _, place, path, root in found], "_part string, _top array<string>, _root string"))
    else:
        target = f"{shared}/peaks-{uuid.uuid4().hex}"
        peaks.repartitionByRange("_part").sortWithinPartitions("_part").select(F.lit("").alias("_all"), F.col("_part").alias("_name"), "_node", F.monotonically_increasing_id().alias("_sorted")).write.parquet(target)
        placed = _placed(spark.read.parquet(target).withColumnRenamed("_all", "_part"))
        rooted = _paths(placed.select("_part", "_place", "_n", "_node"), shared, block, top).select("_place", F.col("_up").alias("_top"), F.col("_peak").alias("_root"))
        roots = placed.select("_place", F.col("_name").alias("_part")).join(rooted, "_place").drop("_place")
    return upper.join(roots, "_part").withColumn("_up", F.concat("_up", "_top")).drop("_top")


def _placed(rows: DataFrame) -> DataFrame:
    """Sorted rows (_part, _sorted: partition and row number of a sort) with their place in the part and the part's size."""
    at = rows.withColumn("_slice", F.shiftright("_sorted", 33))
    counts = at.groupBy("_part", "_slice").agg(F.count("*").alias("_in"), F.min("_sorted").alias("_first"))
    part = Window.partitionBy("_part")  # a row for each slice of the sort
    before = counts.select("_part", "_slice", "_first", (F.sum("_in").over(part.orderBy("_slice")) - F.col("_in")).alias("_before"), F.sum("_in").over(part).alias("_n"))
    return at.join(before, ["_part", "_slice"]).withColumn("_place", F.col("_before") + F.col("_sorted") - F.col("_first")).drop("_slice", "_first", "_before", "_sorted")


def manifest(df: DataFrame, leaf: Column, *, key: str = "doc_id", part: str = "lang", carry: Sequence[str] = ("doc_id",), block: int = BLOCK, top: int = TOP) -> DataFrame:
    """The carried columns, part, place (in the part, by ``key``), leaf, peak (of the part), root and path (to the root) of every row.

    ``block`` is a power of two.  Leaves, sorted leaves and blocks' nodes are written to the
    shared folder when this is called: the texts are read once, and a lost executor's work
    starts from them.
    """
    if clash := set(carry) & set(RESULTS):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    spark = df.sparkSession
    ship(spark)
    shared = folder(spark, "merkle")
    named = F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit(""))  # null first
    df.select(named.alias("_part"), F.col(key).alias("_key"), leaf.alias("_node"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry))).write.parquet(f"{shared}/leaves")
    leaves = spark.read.parquet(f"{shared}/leaves").withColumn("_row", F.monotonically_increasing_id())  # parts repeated rows of one key among tasks
    order = ["_part", "_key", "_node", "_row"]
    leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key", "_row").withColumn("_sorted", F.monotonically_increasing_id()).write.parquet(f"{shared}/sorted")
    own, blocks = _by_blocks(_placed(spark.read.parquet(f"{shared}/sorted")), shared, block)
    proved = _above(own, _with_root(_paths(blocks, shared, block, top), shared, block, top))
    names = {"part": F.when(F.col("_part") != "", F.substring("_part", 2, 1 << 30)), "place": F.col("_place"), "leaf": F.col("_node"), "peak": F.col("_peak"), "root": F.col("_root"), "path": F.col("_up")}
    return proved.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)), *(column.alias(name) for name, column in names.items()))
