"""The prefix trie of conversations, from sorted turn arrays.

A turn is 16 bytes of a digest of role and text, a conversation the bytes of its turns: in
the order of these keys, conversations with a common prefix stand together, those that end
first before those that go on.  Spark sorts the keys (and ids) over all conversations.  A
task sweeps its slice: neighbours' longest common prefix says which nodes of the stack
close and which open.  Nodes that may go on in other slices are those of the slice's first
and of its last conversation; they leave the task as they are, with what their closed
subtrees added, and one more sweep over these few, slice by slice, stitches the stacks.

A node's parent is known by its least member only when it closes.  Children wait for that
in the task; those of stitched nodes, and of nodes with over WAITING children, find it in a
join.  Of members that end in a node only the digest's state is kept, and the ids of runs
that touch a slice's border leave the task in cells of at most ENDS_BYTES.

Defined results: rows without conv_id are left out; null roles and texts are empty ones;
rows that repeat a turn number (or have none: these come first) are turns of their own, in
the order of their digests; conversations without turns are members of the root; an empty
table has no nodes, not even a root.  A conversation has at most 2**26 turns (its key is
one cell).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from recollect.llm.shared import folder
from recollect.shipping import ship

DIGEST = 16
#: Closed children that wait in a task for one parent; bytes of ids in a cell; parents that a join may broadcast.
WAITING, ENDS_BYTES, BROADCAST_PARENTS = 10_000, 1 << 20, 50_000

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: kind: see below; id, parent_id: of the prefix; slice, side, size (of ids: their number in order), ends: of nodes that are to be stitched.
ROW = f"{NODE}, kind int, id binary, parent_id binary, slice int, side int, size bigint, ends string"
#: A finished node; one whose parent is found by a join; an open node of a slice's border; more ids of its ends.
DONE, ASKS, OPEN, ENDS = range(4)
FIRST, LAST = 0, 1
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ROW.split(", ")])
ROOT = bytes(DIGEST)


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id and a struct (turn, digest, size) for every turn.  Texts don't leave their task."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return turns.where("conv_id is not null").select("conv_id", F.struct("turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), size.alias("size")).alias("t"))


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs (turn, digest, size)."""
    return _turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(turns: DataFrame, base: Column, n: Column) -> DataFrame:
    """turn_lists of conversations whose first turns are replaced by those of another one.

    ``base`` and ``n`` are expressions of conv_id: the first n turns are those of the
    conversation ``base`` (all if it has fewer, none if there is none), then come the own ones
    after the first n.  Conversations with the same base meet in one row.
    """
    families = _turns(turns).groupBy(base.alias("_base")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "t"))).alias("_all"))
    each = families.select("_base", "_all", F.explode(F.array_distinct(F.col("_all.conv_id"))).alias("conv_id")).withColumn("_n", n.cast("int"))
    of = lambda conv: F.transform(F.filter("_all", lambda x: x["conv_id"] == conv), lambda x: x["t"])
    rest = F.slice(of(F.col("conv_id")), F.col("_n") + 1, F.greatest(F.size("_all"), F.lit(1)))
    return each.select("conv_id", F.concat(F.slice(of(F.col("_base")), F.lit(1), F.col("_n")), rest).alias("turns"))


class Node:
    """An open node.  ``asked``: its children find it in a join; ``first``: on the path of a slice's first conversation."""

    __slots__ = ("id", "size", "conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "cells", "waiting", "asked", "first")

    def __init__(self, id_: bytes, size: int, *, asked: bool = False, first: bool = False):
        self.id, self.size, self.asked, self.first = id_, size, asked, first
        self.conv: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = self.cells = 0
        self.ends = None
        self.waiting: list[tuple[tuple, bytes | None]] = []  # closed children

    def add_members(self, least: int | None, n: int) -> None:
        self.n_convs += n
        if least is not None and (self.conv is None or least < self.conv):
            self.conv = least

    def add_ends(self, text: str) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(text.encode())
        else:
            self.ends.update(f",{text}".encode())

    def row(self, depth: int, digest: str | None) -> tuple:
        return (self.conv, depth, None, self.n_convs, self.n_children, self.n_leaves, self.saved, digest)


class Rows:
    """Rows on their way out, in batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def node(self, row: tuple, kind: int, id_: bytes | None, parent_id: bytes | None = None) -> None:
        self.rows.append((*row, kind, id_, parent_id, None, None, None, None))

    def border(self, row: tuple, kind: int, id_: bytes, slice_: int, side: int, size: int, ends: str | None = None) -> None:
        self.rows.append((*row, kind, id_, None, slice_, side, size, ends))

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _close(stack: list[Node], out: Rows) -> None:
    """The deepest open node is complete: its parent takes its sums, and its children learn their parent."""
    node = stack.pop()
    node.saved += (node.n_convs - 1) * node.size
    node.n_leaves = node.n_leaves or 1
    for child, id_ in node.waiting:
        out.node((*child[:2], node.conv, *child[3:]), DONE, id_)
    row = node.row(len(stack), (node.ends or hashlib.sha256()).hexdigest())
    id_ = node.id if node.asked else None
    if not stack:
        out.node(row, DONE, id_)
        return
    parent = stack[-1]
    parent.add_members(node.conv, node.n_convs)
    parent.n_children += 1
    parent.n_leaves += node.n_leaves
    parent.saved += node.saved
    if len(parent.waiting) >= WAITING:
        _ask(parent, out)
    if parent.asked:
        out.node(row, ASKS, id_, parent.id)
    else:
        parent.waiting.append((row, id_))


def _ask(node: Node, out: Rows) -> None:
    """From now on the node's children are sent on without their parent."""
    node.asked = True
    for child, id_ in node.waiting:
        out.node(child, ASKS, id_, node.id)
    node.waiting = []


def _common(a: bytes, b: bytes) -> int:
    """How many turns two keys share."""
    if a == b:
        return len(a) // DIGEST
    n = min(len(a), len(b)) // DIGEST
    for k in range(n):
        if a[DIGEST * k : DIGEST * (k + 1)] != b[DIGEST * k : DIGEST * (k + 1)]:
            return k
    return n


class Slice:
    """The sweep over one slice of the sorted conversations."""

    def __init__(self, number: int):
        self.number, self.out = number, Rows()
        self.stack: list[Node] = []
        self.last: bytes | None = None
        self.run: list[str] = []  # ids that end in the deepest node and aren't in its digest
        self.held = 0

    def add(self, key: bytes, conv: int, sizes: list[int]) -> None:
        if self.last is None:
            self.stack.append(Node(ROOT, 0, asked=True, first=True))
            common = 0
        elif key == self.last:
            common = len(key) // DIGEST
        else:
            common = _common(self.last, key)
            self.end_run(self.stack[-1].first)
            self.cut(common)
        for k in range(common, len(key) // DIGEST):
            id_ = hashlib.sha256(self.stack[-1].id + key[DIGEST * k : DIGEST * (k + 1)]).digest()[:DIGEST]
            self.stack.append(Node(id_, sizes[k], asked=self.last is None, first=self.last is None))
        self.last = key
        self.stack[-1].add_members(conv, 1)
        self.run.append(text := str(conv))
        self.held += len(text) + 1
        if self.held > ENDS_BYTES:
            self.end_run(True)

    def end_run(self, as_cell: bool) -> None:
        """Ids go to their node's digest; as a cell too, where the node may have more in other slices."""
        if not self.run:
            return
        node, ends = self.stack[-1], ",".join(self.run)
        self.run, self.held = [], 0
        node.add_ends(ends)
        if as_cell or node.cells:
            node.cells += 1
            self.out.border((None, len(self.stack) - 1, None, 0, 0, 0, 0, None), ENDS, node.id, self.number, FIRST if node.first else LAST, node.cells, ends)

    def cut(self, depth: int) -> None:
        """Nodes deeper than that close; those of the first conversation leave for the stitching."""
        while len(self.stack) > depth + 1:
            if self.stack[-1].first:
                self.leave()
            else:
                _close(self.stack, self.out)

    def leave(self) -> None:
        node = self.stack.pop()
        _ask(node, self.out)
        digest = None if node.ends is None or node.cells else node.ends.hexdigest()
        self.out.border(node.row(len(self.stack), digest), OPEN, node.id, self.number, FIRST if node.first else LAST, node.size)

    def finish(self) -> None:
        self.end_run(True)
        while self.stack:
            self.leave()


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations (key, conv_id, sizes) of a slice -> finished nodes, and the open ones of its borders."""
    own = Slice(TaskContext.get().partitionId())
    for batch in batches:
        for key, conv, sizes in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            own.add(key, conv, sizes)
        yield from own.out.batches(20_000)
    own.finish()
    yield from own.out.batches()


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes of all slices, by slice, side and depth: the sweep goes on over these."""
    out = Rows()
    stack: list[Node] = []
    at, following = None, False

    def cut(depth: int) -> None:
        while len(stack) > depth + 1:
            _close(stack, out)

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            same = depth < len(stack) and stack[depth].id == r["id"]
            if r["kind"] == ENDS:
                if same:  # else a long run that touches no border
                    stack[depth].add_ends(r["ends"])
                continue
            if (r["slice"], r["side"]) != at:
                at, following = (r["slice"], r["side"]), r["side"] == FIRST
                if not following:
                    cut(depth - 1)
            if not (following and same):
                cut(depth - 1)
                following = False
                stack.append(Node(r["id"], r["size"], asked=True))
            node = stack[depth]
            node.add_members(r["conv_id"], r["n_convs"])
            node.n_children += r["n_children"]
            node.n_leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            if r["ends_sha256"] is not None:
                node.ends = _Digest(r["ends_sha256"])
        yield from out.batches(20_000)
    cut(-1)
    yield from out.batches()


class _Digest:
    """A finished digest."""

    def __init__(self, text: str):
        self.text = text

    def hexdigest(self) -> str:
        return self.text


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turns as in turn_lists) -> a row for every node of their trie (NODE).

    Keys, the slices' nodes and the stitched nodes are written to the shared folder when this is called.
    """
    spark = conversations.sparkSession
    ship(spark)
    shared = folder(spark, "trie")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    conversations.select(key.alias("key"), "conv_id", F.col("turns.size").alias("sizes")).write.parquet(f"{shared}/keys")
    keys = spark.read.parquet(f"{shared}/keys")
    keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(sweep, ROW).write.parquet(f"{shared}/swept")
    swept = spark.read.schema(ROW).parquet(f"{shared}/swept")
    # the borders of all slices: at most two conversations' depths for each
    borders = swept.where(f"kind in ({OPEN}, {ENDS})").repartition(1).sortWithinPartitions("slice", "side", "depth", "kind", "size")
    borders.mapInArrow(stitch, ROW).write.parquet(f"{shared}/stitched")
    nodes = swept.where(f"kind in ({DONE}, {ASKS})").unionByName(spark.read.schema(ROW).parquet(f"{shared}/stitched"))
    parents = nodes.where("id is not null").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("found"))
    n = parents.count()
    names = [x.split()[0] for x in NODE.split(", ")]
    asks = nodes.where(f"kind = {ASKS}")
    known = asks.join(F.broadcast(parents) if n <= BROADCAST_PARENTS else parents, "parent_id").withColumn("parent_conv_id", F.col("found"))
    return nodes.where(f"kind = {DONE}").select(names).unionByName(known.select(names))
