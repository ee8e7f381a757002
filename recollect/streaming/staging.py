"""Streams with state: staging that is flushed by a count, and working memory that spills.

State is kept for each key (a store, an agent): keys are dealt over the tasks, and a key's
rows come in the order of ``order`` within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollect.functions.constants import WORKING_CAPACITY

FLUSH_ROWS = 1_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FLUSHED = "store string, id bigint, flush bigint"
TIERS = "agent string, id bigint, tier string, at bigint"


def _in_order(rows: Iterator[pd.DataFrame]) -> list[int]:
    """The ids of a batch in their order."""
    found = [x for x in rows if len(x)]
    if not found:
        return []
    return pd.concat(found).sort_values(["place", "id"], kind="stable")["id"].tolist()


class Staging(StatefulProcessor):
    """Rows wait in a list until there are enough; then all that wait leave as one flush."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id bigint")
        self.counts = handle.getValueState("counts", "waiting bigint, flushes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, flushes = self.counts.get() if self.counts.exists() else (0, 0)
        new = _in_order(rows)
        if n + len(new) < self.threshold:  # the list only grows, and isn't read
            self.waiting.appendList([(i,) for i in new])
            self.counts.update((n + len(new), flushes))
            return
        held = [r[0] for r in self.waiting.get()] + new
        out = []
        while len(held) >= self.threshold:
            flushes += 1
            out += [(key[0], i, flushes) for i in held[: self.threshold]]
            held = held[self.threshold :]
        self.waiting.clear()
        if held:
            self.waiting.put([(i,) for i in held])
        self.counts.update((len(held), flushes))
        yield pd.DataFrame(out, columns=["store", "id", "flush"])

    def close(self) -> None:
        pass


class Working(StatefulProcessor):
    """Working memory of an agent: at capacity + 1 its oldest half becomes episodic."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.working = handle.getListState("working", "id bigint")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.working.get()]  # at most the capacity
        at = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        for i in _in_order(rows):
            at += 1
            held.append(i)
            out.append((key[0], i, "working", at))
            if len(held) > self.capacity:
                half = len(held) // 2
                out += [(key[0], j, "episodic", at) for j in held[:half]]
                held = held[half:]
        self.working.clear()
        if held:
            self.working.put([(i,) for i in held])
        self.seen.update((at,))
        yield pd.DataFrame(out, columns=["agent", "id", "tier", "at"])

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, id_: str, order: str):
    return stream.select(F.col(key).cast("string").alias("key"), F.col(id_).cast("bigint").alias("id"), F.col(order).cast("bigint").alias("place")).groupBy("key")


def flushes(stream: DataFrame, *, key: str, id_: str = "id", order: str = "id", threshold: int = FLUSH_ROWS) -> DataFrame:
    """store, id, flush: the rows that a store's staging lets go, by the number of the flush; others still wait.  Needs STATE_STORE."""
    return _keyed(stream, key, id_, order).transformWithStateInPandas(Staging(threshold), FLUSHED, outputMode="Append", timeMode="None")


def tier_changes(stream: DataFrame, *, key: str = "agent_id", id_: str = "id", order: str = "ts_ms", capacity: int = WORKING_CAPACITY) -> DataFrame:
    """agent, id, tier, at: each record when it comes, and again when it is spilled.  Needs STATE_STORE."""
    return _keyed(stream, key, id_, order).transformWithStateInPandas(Working(capacity), TIERS, outputMode="Append", timeMode="None")


def present_tiers(changes: DataFrame) -> DataFrame:
    """agent, id, tier: where every record is after all its changes."""
    return changes.groupBy("agent", "id").agg(F.max_by("tier", F.struct("at", (F.col("tier") == "episodic").alias("spilled"))).alias("tier"))
