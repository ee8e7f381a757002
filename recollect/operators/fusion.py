"""Reciprocal-rank fusion, filters, recency and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.constants import HALF_LIFE_MS, RRF_K
from recollect.functions.scores import blended, boosted, decay, rounded
from recollect.operators.ranking import top_k


def rrf_scores(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, score: the sum of 1 / (k + rank) over ranked lists, whether they all have the id or not."""
    parts = [x.select("query_id", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.groupBy("query_id", "id").agg(rounded(F.sum("part")).alias("score"))


def rrf(*lists: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    return top_k(rrf_scores(*lists, k=k), ["query_id"], top)


def passes(query: str = "q", record: str = "r") -> Column:
    """The metadata filter between a query (session_filter, agent_filter, role_filter, time_start, time_end) and a record; null asks nothing, both times are included."""
    q, r = (lambda c: F.col(f"{query}.{c}")), (lambda c: F.col(f"{record}.{c}"))
    wants = lambda f, c: q(f).isNull() | (q(f) == r(c))
    return wants("session_filter", "session_id") & wants("agent_filter", "agent_id") & wants("role_filter", "role") & (q("time_start").isNull() | (r("ts_ms") >= q("time_start"))) & (q("time_end").isNull() | (r("ts_ms") <= q("time_end")))


def kept_candidates(candidates: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """Ranked candidates that pass their query's filter.  Ranks stay what they were, and fewer than k may be left."""
    asked = candidates.join(queries.drop("text", "embedding"), "query_id").join(records.select("id", "session_id", "agent_id", "role", "ts_ms"), "id")
    mine = asked.select("query_id", "id", "rank", F.struct(*(c for c in ("session_filter", "agent_filter", "role_filter", "time_start", "time_end"))).alias("q"), F.struct("session_id", "agent_id", "role", "ts_ms").alias("r"))
    return mine.where(passes()).select("query_id", "id", "rank")


def memory_fuse(sparse: DataFrame, dense: DataFrame, queries: DataFrame, records: DataFrame, now: int | Column, *, top: int, half_life_ms: float = HALF_LIFE_MS, importance: bool = True) -> DataFrame:
    """Filter both candidate lists, fuse them, blend in recency by the query's weight, boost by importance and rank.

    query_id, id, relevance, recency, score, rank.
    """
    kept = [kept_candidates(x, queries, records) for x in (sparse, dense)]
    fused = rrf_scores(*kept).withColumnRenamed("score", "relevance")
    at = F.lit(now) if isinstance(now, int) else now
    known = fused.join(records.select("id", "ts_ms", "importance", at.alias("_now")), "id").join(queries.select("query_id", "recency_weight"), "query_id")
    known = known.withColumn("recency", rounded(decay(F.col("_now") - F.col("ts_ms"), half_life_ms)))
    score = blended(F.col("relevance"), F.col("recency"), F.col("recency_weight"))
    score = boosted(score, F.col("importance")) if importance else score
    return top_k(known.select("query_id", "id", "relevance", "recency", rounded(score).alias("score")), ["query_id"], top)


#: Conditions of equality that a query may ask for: its column and the record's.
EQUAL = (("session_filter", "session_id"), ("agent_filter", "agent_id"), ("role_filter", "role"))
TIME_BINS = 64


def matches(queries: DataFrame, records: DataFrame, bins: int = TIME_BINS) -> DataFrame:
    """query_id, id of all records that pass a query's filter, without comparing all pairs.

    Times fall into bins with about as many records each.  A query asks for the bins of its
    interval (all, where it has none), and joins by bin and by all the columns that it names;
    there is a join for each set of named columns.  Null asks nothing, a null field passes no
    condition on it.
    """
    spark = records.sparkSession
    shares = [k / bins for k in range(1, bins)]
    bounds = sorted(set(records.agg(F.percentile_approx("ts_ms", shares, 10_000)).first()[0] or []))
    edges = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    bin_of = lambda t: F.when(t.isNotNull(), F.size(F.filter(edges, lambda b: b < t)))
    fields = [r for _, r in EQUAL]
    held = records.select("id", "ts_ms", *fields, F.coalesce(bin_of(F.col("ts_ms")), F.lit(0)).alias("bin"))
    first, last = (F.coalesce(bin_of(F.col(c)), F.lit(other)) for c, other in (("time_start", 0), ("time_end", len(bounds))))
    asked = queries.select("query_id", "time_start", "time_end", *(q for q, _ in EQUAL)).withColumn("asked_bin", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    found = spark.createDataFrame([], "query_id bigint, id bigint")
    for named in range(1 << len(EQUAL)):
        pairs = [pair for k, pair in enumerate(EQUAL) if named >> k & 1]
        own = asked.where(" and ".join(f"{q} is {'not ' if (q, r) in pairs else ''}null" for q, r in EQUAL))
        on = F.col("asked_bin") == F.col("bin")
        for q, r in pairs:
            on &= F.col(q) == F.col(r)
        in_time = (F.col("time_start").isNull() | (F.col("ts_ms") >= F.col("time_start"))) & (F.col("time_end").isNull() | (F.col("ts_ms") <= F.col("time_end")))
        found = found.union(own.join(held, on).where(in_time).select("query_id", "id"))
    return found
