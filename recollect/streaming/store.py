"""A store that is written by a stream and read by snapshots, with an index that grows by segments.

A flush writes its records and a segment of postings to folders of its own, and then
publishes a manifest: a small file with the number of the next version, which names all
folders that belong to it.  It appears as a whole or not at all, and only one writer can
publish a version.  Readers read a manifest first, so they see whole flushes, and a version
once read stays readable.  A flush that is tried again before it was published writes new
folders; after that it changes nothing.

A segment has the postings (term, id, times in the record, the record's length); the number
of records and of tokens stand in the manifest.  Statistics of a search are sums over
segments, so a search reads postings of its terms and no texts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.functions.scores import bm25_term, idf, rounded
from recollect.functions.text import tokens
from recollect.operators.lexical import query_terms, search
from recollect.operators.ranking import top_k

RECORD = "session_id string, agent_id string, role string, ts_ms bigint, content string, importance double"
POSTING = "term string, id bigint, n bigint, length bigint"


@dataclass
class Store:
    """The store in a folder.  ``schema``: the records' columns after their id."""

    spark: SparkSession
    path: str
    schema: str = RECORD
    rows_id: str = "source_id"
    text: str = "content"

    @property
    def record(self) -> str:
        return f"{self.rows_id} bigint, {self.schema}, batch bigint"

    # manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The published versions."""
        top = self._path("manifests")
        fs = self._files()
        if not fs.exists(top):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(top)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, or that of the last one; an empty store is version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "flushes": [], "segments": []}
        stream = self._files().open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, change: Callable[[dict], dict | None]) -> int:
        """Publish what ``change`` makes of the last manifest (None: nothing) as the next version, or try again where another writer was first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while True:
            last = self.manifest()
            new = change(json.loads(json.dumps(last)))
            if new is None:
                return last["version"]
            new["version"] = last["version"] + 1
            waiting = self._path(f"manifests/_waiting-{uuid.uuid4().hex}")
            out = self._files().create(waiting)
            out.write(json.dumps(new).encode())
            out.close()
            renames = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:  # fails where the version exists
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), conf).rename(waiting, self._path(f"manifests/v{new['version']:012d}.json"), renames)
                return new["version"]
            except Exception as error:
                self._files().delete(waiting, False)
                if "FileAlreadyExists" not in str(error) or new["version"] not in self.versions():
                    raise

    # writing

    def flush(self, rows: DataFrame, batch: int) -> int:
        """Make a batch of records visible, as a whole and once: the version that has it."""
        if any(f["batch"] == batch for f in self.manifest()["flushes"]):
            return self.manifest()["version"]
        name = f"{batch}-{uuid.uuid4().hex}"
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.parquet(f"{self.path}/records/{name}")
        written = self.spark.read.schema(self.record).parquet(f"{self.path}/records/{name}")
        self._segment(written).write.parquet(f"{self.path}/segments/{name}")
        length = F.size(tokens(self.text)).cast("bigint")
        n, total = written.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()

        def change(manifest: dict) -> dict | None:
            if any(f["batch"] == batch for f in manifest["flushes"]):
                return None
            manifest["flushes"].append({"batch": batch, "records": name, "n": n, "tokens": total})
            manifest["segments"].append(name)
            return manifest

        return self.publish(change)

    def _segment(self, rows: DataFrame) -> DataFrame:
        said = rows.select(F.col(self.rows_id).alias("id"), tokens(self.text).alias("t")).select("id", F.size("t").cast("bigint").alias("length"), F.explode("t").alias("term"))
        return said.groupBy("term", "id", "length").agg(F.count("*").alias("n")).select("term", "id", "n", "length").sortWithinPartitions("term", "id")

    def compact(self) -> int:
        """One segment, sorted by term over all its files, for all that there are; earlier versions keep theirs."""
        merged = self.manifest()["segments"]
        if len(merged) < 2:
            return self.manifest()["version"]
        name = f"compact-{uuid.uuid4().hex}"
        self._postings(merged).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.path}/segments/{name}")

        def change(manifest: dict) -> dict | None:
            if not set(merged) <= set(manifest["segments"]):
                return None  # another compaction was first
            manifest["segments"] = [name, *(s for s in manifest["segments"] if s not in merged)]
            return manifest

        return self.publish(change)

    # reading

    def records(self, version: int | None = None) -> DataFrame:
        """The records of a version, or of the last."""
        folders = [f"{self.path}/records/{f['records']}" for f in self.manifest(version)["flushes"]]
        return self.spark.read.schema(self.record).parquet(*folders) if folders else self.spark.createDataFrame([], self.record)

    def _postings(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(*(f"{self.path}/segments/{s}" for s in segments)) if segments else self.spark.createDataFrame([], POSTING)

    def search(self, queries: DataFrame, k: int, version: int | None = None) -> DataFrame:
        """BM25 over the segments of a version: query_id, id, score, rank."""
        manifest = self.manifest(version)
        n, total = (sum(f[c] for f in manifest["flushes"]) for c in ("n", "tokens"))
        asked = query_terms(queries)
        found = self._postings(manifest["segments"]).join(asked.select("term").distinct(), "term", "left_semi")
        terms = found.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(n), F.col("df")))
        weight = bm25_term(F.col("idf"), F.col("n").cast("double") / F.col("length"), F.col("length"), F.lit(total / n if n else 0.0))
        weighed = found.join(terms, "term").select("term", "id", weight.alias("weight"))
        scores = asked.join(weighed, "term").groupBy("query_id", "id").agg(rounded(F.sum(F.col("times") * F.col("weight"))).alias("score"))
        return top_k(scores.where("score > 0"), ["query_id"], k)


def append_stream(spark: SparkSession, source: str, store: str, checkpoint: str, *, schema: str = RECORD, rows_id: str = "source_id", files: int | None = None) -> StreamingQuery:
    """Flush everything that is waiting in ``source`` (JSON files) to the store, then end.  ``files``: at most so many files a flush."""
    reader = spark.readStream.schema(f"{rows_id} bigint, {schema}")
    waiting = (reader.option("maxFilesPerTrigger", files) if files else reader).json(source)
    target = Store(spark, store, schema, rows_id)
    return waiting.writeStream.foreachBatch(lambda batch, number: target.flush(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, store: str, *, schema: str = RECORD, rows_id: str = "source_id", upto: int | None = None) -> DataFrame:
    """The records that are visible, all or as they were after a flush; an empty store has none."""
    rows = Store(spark, store, schema, rows_id).records()
    return rows if upto is None else rows.where(F.col("batch") <= upto)


def retrieve(queries: DataFrame, visible: DataFrame, k: int, rows_id: str = "source_id") -> DataFrame:
    """BM25 over any records: what still waits isn't found."""
    return search(queries, visible.select(F.col(rows_id).alias("id"), F.col("content").alias("text")), k)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events by role in tumbling windows, with late ones up to ``late`` behind; streams and tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), "role").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "role", "n")
