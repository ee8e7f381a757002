"""The tables that searches work on, derived from parquet; CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from recollect.functions.constants import FIRST_TS, IMPORTANCE, SESSION_MS, TURN_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str = "id", top: Column | None = None) -> DataFrame:
    """Row numbers from 0 in the order of (bucket, order), where ``bucket`` rises with the order.

    Numbers within buckets and running sums over the buckets' counts, in two steps: no task
    sorts all rows, nor all buckets.  ``top`` brings neighbouring buckets (``_bucket``, whole
    numbers unless it is given) together.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").count().withColumn("_top", F.floor(F.col("_bucket") / 4096) if top is None else top)
    tops = counts.groupBy("_top").agg(F.sum("count").alias("_sum"))
    above = tops.select("_top", (F.sum("_sum").over(Window.orderBy("_top")) - F.col("_sum")).alias("_above"))  # one row for 4096 buckets
    within = F.sum("count").over(Window.partitionBy("_top").orderBy("_bucket")) - F.col("count")
    before = counts.withColumn("_within", within).join(above, "_top").select("_bucket", (F.col("_above") + F.col("_within")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_place", place).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("bigint")).drop("_bucket", "_place", "_before")


def embedding_of(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Column) -> DataFrame:
    """Rows with the embedding whose id is the number modulo the embeddings' count."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    n = vectors.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("_vec", F.pmod(number, F.col("_n"))).join(vectors, "_vec").drop("_vec", "_n")  # one row


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, embedding"""
    return embedding_of(spark, sf_dir, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("id"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding"""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id")


def importance_of(role: Column, default: float = 0.5) -> Column:
    out = F.lit(default)
    for name, value in IMPORTANCE.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def memory_records(spark: SparkSession, sf_dir: str, embeddings: bool = False) -> DataFrame:
    """id, session_id, agent_id, role, tool, ts_ms, content, importance (and embedding) of every turn."""
    turns = numbered(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 4096), ["conv_id", "turn"])
    out = turns.select(
        "id",
        F.format_string("sess-%06d", "conv_id").alias("session_id"),
        F.pmod("conv_id", F.lit(6)).alias("agent_id"),
        "role",
        F.lit("").alias("tool"),
        (F.lit(FIRST_TS) + F.col("conv_id") * SESSION_MS + F.col("turn") * TURN_MS).alias("ts_ms"),
        F.col("text").alias("content"),
        importance_of(F.col("role")).alias("importance"),
    )
    return embedding_of(spark, sf_dir, out, F.col("id")) if embeddings else out


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, role, ts_ms, importance of every event."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("role"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.pmod("event_id", F.lit(10)) / 10).alias("importance"))


def lookup(records: DataFrame, id_: int, column: str = "id") -> DataFrame:
    """The record with an id, or none."""
    return records.where(F.col(column) == id_)


def write_csv(rows: DataFrame, path: str, *, append: bool = False, digits: int | None = 3) -> None:
    """CSV with a header; doubles with a fixed number of digits."""
    if digits is not None:
        rows = rows.select(*(F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    rows.write.csv(path, header=True, mode="append" if append else "overwrite")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
