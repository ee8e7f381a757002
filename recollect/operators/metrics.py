"""Aggregates over stores, results and benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from recollect.functions.scores import amdahl, serial_fraction


def counts_by(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("n"))


def overview(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("agent_id").alias("agents"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.round(F.avg("importance"), 8).alias("mean_importance"))


def tier_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "tier").agg(F.count("*").alias("n"))


def speedups(runs: DataFrame) -> DataFrame:
    """corpus_size, strategy, threads, total_ms -> speedup over the sequential run of the size, and efficiency in per cent."""
    base = runs.where("strategy = 'sequential'").groupBy("corpus_size").agg(F.min("total_ms").alias("base"))
    out = runs.join(base, "corpus_size").withColumn("speedup", F.col("base") / F.col("total_ms"))
    return out.select("corpus_size", "strategy", "threads", F.round("speedup", 8).alias("speedup"), F.round(100 * F.col("speedup") / F.col("threads"), 8).alias("efficiency"))


def amdahl_table(runs: DataFrame) -> DataFrame:
    """Serial share of every parallel run, the prediction by its strategy's mean share, and the gap."""
    rows = speedups(runs).where("threads > 1").withColumn("serial", serial_fraction(F.col("speedup"), F.col("threads")))
    mean = Window.partitionBy("corpus_size", "strategy")
    rows = rows.withColumn("predicted", amdahl(F.avg("serial").over(mean), F.col("threads")))
    return rows.select("corpus_size", "strategy", "threads", F.round("serial", 8).alias("serial"), F.round("predicted", 8).alias("predicted"), F.round(F.col("speedup") - F.col("predicted"), 8).alias("gap"))


def best_runs(runs: DataFrame) -> DataFrame:
    """The run with the greatest speed-up of every size; of equals the one with fewer threads."""
    window = Window.partitionBy("corpus_size").orderBy(F.desc("speedup"), "threads", "strategy")
    return speedups(runs).withColumn("place", F.row_number().over(window)).where("place = 1").drop("place")


def pivoted(runs: DataFrame, strategies: list[str]) -> DataFrame:
    """corpus_size with a column of the best speed-up for every strategy."""
    return speedups(runs).groupBy("corpus_size").pivot("strategy", strategies).agg(F.max("speedup"))


def mean_timings(runs: DataFrame) -> DataFrame:
    """Mean latency and queries a second of every strategy."""
    return runs.groupBy("strategy").agg(F.round(F.avg(F.col("total_ms") / F.col("num_queries")), 8).alias("avg_latency_ms"), F.round(F.avg(1000 * F.col("num_queries") / F.col("total_ms")), 8).alias("throughput_qps"))
