"""Ranking: the only place where rows are ranked and cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, groups: Sequence[str], score: str = "score", tie: str = "id", name: str = "rank") -> DataFrame:
    """Rank from 1 by score, best first; of equal scores the smaller id comes first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), tie)).cast("bigint"))


def top_k(df: DataFrame, groups: Sequence[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each group.  Spark cuts each task's groups to k before it shuffles them."""
    window = Window.partitionBy(*groups).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def global_top(df: DataFrame, k: int, score: str = "score", ties: Sequence[str] = ("id",)) -> DataFrame:
    """The k best of all: tasks keep k rows each, and those are merged."""
    return df.orderBy(F.desc(score), *ties).limit(k)


def last_rows(df: DataFrame, k: int, order: str) -> DataFrame:
    """The k rows that came last."""
    return df.orderBy(F.desc(order)).limit(k)


def match_rates(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("query_id",), tolerance: float = 1e-4) -> DataFrame:
    """Per query: whether the first ids agree (or their scores do), and whether all scores do, of two ranked results."""
    x = a.select(*keys, "rank", F.col("id").alias("a_id"), F.col("score").alias("a_score"))
    y = b.select(*keys, "rank", F.col("id").alias("b_id"), F.col("score").alias("b_score"))
    near = F.abs(F.col("a_score") - F.col("b_score")) <= tolerance
    both = x.join(y, [*keys, "rank"], "full")
    first = F.max(F.when(F.col("rank") == 1, F.coalesce((F.col("a_id") == F.col("b_id")) | near, F.lit(False)).cast("int")))
    return both.groupBy(*keys).agg(first.cast("bigint").alias("top1"), F.min(F.coalesce(near, F.lit(False)).cast("int")).cast("bigint").alias("exact"))


def kendall_tau(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """Kendall's tau of the ids that both lists rank; 1 where fewer than two are in both."""
    both = a.select(key, "id", F.col("rank").alias("x")).join(b.select(key, "id", F.col("rank").alias("y")), [key, "id"])
    other = both.select(key, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = both.join(other, key).where("x < x2").select(key, F.signum((F.col("x") - F.col("x2")) * (F.col("y") - F.col("y2"))).alias("s"))
    tau = pairs.groupBy(key).agg((F.sum("s") / F.sum(F.abs("s"))).alias("tau"))
    return a.select(key).distinct().join(tau, key, "left").select(key, F.round(F.coalesce("tau", F.lit(1.0)), 8).alias("tau"))
