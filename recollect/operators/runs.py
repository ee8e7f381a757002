"""Runs of equal values in an order: gaps and islands with borders between the slices of a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

RUN = "run bigint, value, first, last, n"


def runs(df: DataFrame, order: list[str], value: str, path: str) -> DataFrame:
    """run (from 0), value, the first and last row's ``order`` columns and n of every maximal run of one value (null is a value).

    The sorted rows are written to ``path`` with their slice and place; runs are numbered
    within slices, and a row for each slice tells whether its first run goes on from the last.
    """
    spark = df.sparkSession
    rows = df.select(*order, F.col(value).alias("_value"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_slice", F.shiftright("_at", 33))
    own = Window.partitionBy("_slice").orderBy("_at")
    before = F.lag(F.struct("_value")).over(own)
    placed = placed.withColumn("_new", (before.isNull() | ~F.col("_value").eqNullSafe(before["_value"])).cast("int"))
    numbered = placed.withColumn("_own", F.sum("_new").over(own))
    inner = numbered.groupBy("_slice", "_own").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.first("_value").alias("_value"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count("*").alias("n"))
    edges = placed.groupBy("_slice").agg(F.min_by(F.struct("_value"), "_at").alias("_left"), F.max_by(F.struct("_value"), "_at").alias("_right"), F.sum("_new").alias("_runs"))
    slices = Window.orderBy("_slice")  # one row for each slice of the sort
    joins = F.coalesce(F.lag("_right").over(slices).eqNullSafe(F.col("_left")), F.lit(False)).cast("int")
    base = edges.withColumn("_joins", joins).withColumn("_base", F.coalesce(F.sum("_runs").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_joins").over(slices)).select("_slice", "_base")
    whole = inner.join(base, "_slice").withColumn("run", (F.col("_base") + F.col("_own") - 1).cast("bigint"))
    return whole.groupBy("run").agg(F.first("_value").alias("value"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").cast("bigint").alias("n"))
