"""Search by time buckets, newest first, with statistics of their own in every bucket.

``search_early_stop`` is one plan over the newest buckets.  ``search_stored`` works on a table
that is stored by bucket: it reads the newest one, then the next one for the queries that are
not done, and no bucket that nobody asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from recollect.functions.constants import EARLY_STOP, MOST_BUCKETS, WEEK_MS
from recollect.operators.lexical import search
from recollect.operators.ranking import top_k

#: The folder with the counts of stored buckets.
COUNTS = "_counts"


def bucketed(records: DataFrame, width_ms: int = WEEK_MS) -> DataFrame:
    """Records with ``bucket``: whole widths since the first record."""
    first = records.agg(F.min("ts_ms").alias("_first"))
    return records.crossJoin(F.broadcast(first)).withColumn("bucket", F.floor((F.col("ts_ms") - F.col("_first")) / width_ms)).drop("_first")  # one row


def newest(records: DataFrame, most: int = MOST_BUCKETS) -> DataFrame:
    """bucket, records, po: the newest buckets that have records, po from 1."""
    counts = records.groupBy("bucket").agg(F.count("*").alias("records"))
    found = counts.orderBy(F.desc("bucket")).limit(most)
    return found.withColumn("po", F.row_number().over(Window.orderBy(F.desc("bucket"))))  # at most `most` rows


def candidates(queries: DataFrame, records: DataFrame, k: int, most: int = MOST_BUCKETS) -> DataFrame:
    """query_id, id, score, po: each of the newest buckets' k best.  records: id, text, bucket."""
    places = newest(records, most)
    near = records.join(F.broadcast(places.select("bucket")), "bucket").select("id", "text", "bucket")
    return search(queries, near, k, by=["bucket"]).drop("rank").join(F.broadcast(places.select("bucket", "po")), "bucket").select("query_id", "id", "score", "po")


def search_fixed(queries: DataFrame, records: DataFrame, k: int, most: int = MOST_BUCKETS) -> DataFrame:
    """The k best of the newest buckets."""
    return top_k(candidates(queries, records, k, most), ["query_id"], k).select("query_id", "id", "score", "rank")


def stops(queries: DataFrame, found: DataFrame, records: DataFrame, k: int, most: int = MOST_BUCKETS, threshold: float = EARLY_STOP) -> DataFrame:
    """query_id, stop: after how many buckets a search ends: the k-th score is near enough the best, or there are no more."""
    last = newest(records, most).agg(F.max("po").alias("last"))
    prefixes = found.withColumn("prefix", F.explode(F.sequence(F.col("po"), F.lit(most))))
    best = Window.partitionBy("query_id", "prefix")
    seen = top_k(prefixes, ["query_id", "prefix"], k).withColumn("best", F.max("score").over(best))
    enough = seen.where((F.col("rank") == k) & (F.col("best") > 0) & (F.col("score") / F.col("best") > threshold)).groupBy("query_id").agg(F.min("prefix").alias("enough"))
    return queries.select("query_id").join(enough, "query_id", "left").crossJoin(F.broadcast(last)).select("query_id", F.least(F.coalesce("enough", "last"), "last").cast("bigint").alias("stop"))  # one row


def search_early_stop(queries: DataFrame, records: DataFrame, k: int, most: int = MOST_BUCKETS, threshold: float = EARLY_STOP) -> DataFrame:
    """The k best of the buckets that a search reads before it stops: query_id, id, score, rank, stop."""
    found = candidates(queries, records, k, most)
    read = found.join(stops(queries, found, records, k, most, threshold), "query_id").where("po <= stop")
    return top_k(read, ["query_id"], k).select("query_id", "id", "score", "rank", "stop")


def search_stats(queries: DataFrame, records: DataFrame, k: int, most: int = MOST_BUCKETS, threshold: float = EARLY_STOP) -> DataFrame:
    """query_id, partitions_searched, records_searched, search_fraction."""
    found = candidates(queries, records, k, most)
    places = newest(records, most)
    total = records.agg(F.count("*").alias("total"))
    read = stops(queries, found, records, k, most, threshold).join(F.broadcast(places), F.col("po") <= F.col("stop"))  # at most `most` rows
    counted = read.groupBy("query_id").agg(F.count("*").alias("partitions_searched"), F.sum("records").alias("records_searched"))
    return counted.crossJoin(F.broadcast(total)).select("query_id", "partitions_searched", "records_searched", F.round(F.col("records_searched") / F.col("total"), 8).alias("search_fraction"))


def mean_stats(stats: DataFrame) -> DataFrame:
    """queries, and over them the mean buckets searched, the mean share of records searched, and the share skipped."""
    mean = F.avg("search_fraction")
    return stats.agg(F.count("*").alias("queries"), F.round(F.avg("partitions_searched"), 6).alias("partitions_searched"), F.round(mean, 6).alias("search_fraction"), F.round(1 - mean, 6).alias("skip_rate"))


def store_by_bucket(records: DataFrame, path: str) -> None:
    """Write records (with ``bucket``) to a folder for each bucket; Spark splits large buckets among tasks.

    The buckets' counts are a table in a folder that Spark doesn't take for a bucket.
    """
    records.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    counts = records.sparkSession.read.schema(records.schema).parquet(path).groupBy("bucket").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/{COUNTS}")


@dataclass
class StoredSearch:
    """What a search has read and found, in written tables."""

    #: query_id, id, score, po
    found: DataFrame
    #: query_id, po, records: the buckets that a query's search has read
    asked: DataFrame
    k: int

    def results(self) -> DataFrame:
        """query_id, id, score, rank, stop"""
        stop = self.asked.groupBy("query_id").agg(F.max("po").cast("bigint").alias("stop"))
        return top_k(self.found.join(stop, "query_id"), ["query_id"], self.k).select("query_id", "id", "score", "rank", "stop")

    def stats(self, total: int) -> DataFrame:
        """query_id, partitions_searched, records_searched, search_fraction of ``total`` records."""
        counted = self.asked.groupBy("query_id").agg(F.count("*").alias("partitions_searched"), F.sum("records").alias("records_searched"))
        return counted.withColumn("search_fraction", F.round(F.col("records_searched") / F.lit(total), 8))


def search_stored(spark: SparkSession, queries: DataFrame, stored: str, work: str, k: int, most: int = MOST_BUCKETS, threshold: float = EARLY_STOP) -> StoredSearch:
    """Search the buckets of a stored table, newest first.  A step's findings are written to ``work``.

    At most ``most`` steps; a step ends the search when all queries have k results whose last is
    near enough the best.
    """
    newest_first = spark.read.parquet(f"{stored}/{COUNTS}").orderBy(F.desc("bucket")).limit(most).collect()
    active = queries.select("query_id", "text")
    found_schema, asked_schema = "query_id bigint, id bigint, score double, po int", "query_id bigint, po int, records bigint"
    asked = spark.createDataFrame([], asked_schema)
    found = spark.createDataFrame([], found_schema)
    for po, bucket in enumerate(newest_first, 1):
        # by its folder: reading the whole table would open a file of another bucket for the schema
        folder = "__HIVE_DEFAULT_PARTITION__" if bucket["bucket"] is None else bucket["bucket"]
        # records without a time are searched by no one, but count as a bucket
        near = spark.read.parquet(f"{stored}/bucket={folder}").where(F.lit(bucket["bucket"]).isNotNull()).select("id", "text")
        search(active, near, k).select("query_id", "id", "score", F.lit(po).alias("po")).write.parquet(f"{work}/found/step={po}")
        asked = asked.unionByName(active.select("query_id", F.lit(po).alias("po"), F.lit(bucket["n"]).cast("bigint").alias("records")))
        found = spark.read.schema(found_schema).parquet(*(f"{work}/found/step={n}" for n in range(1, po + 1)))
        if po < len(newest_first):
            best = top_k(found, ["query_id"], k).groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("kth"), F.count("*").alias("n"))
            done = best.where((F.col("n") == k) & (F.col("best") > 0) & (F.col("kth") / F.col("best") > threshold)).select("query_id")
            active.join(done, "query_id", "left_anti").write.parquet(f"{work}/left/step={po}")
            active = spark.read.schema(active.schema).parquet(f"{work}/left/step={po}")
            if not active.limit(1).collect():
                break
    return StoredSearch(found, asked, k)
