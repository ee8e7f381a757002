"""Working, semantic and episodic memory: split, search, consolidate, forget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from recollect.functions.constants import CONSOLIDATION_BATCH, FORGET_BELOW, HALF_LIFE_MS, RRF_K, TIER_WEIGHTS, WORKING_CAPACITY
from recollect.functions.scores import decay, rounded
from recollect.functions.text import overlap, preview, tokens
from recollect.functions.vectors import normalised
from recollect.operators.dense import knn
from recollect.operators.fusion import rrf_scores
from recollect.operators.lexical import search
from recollect.operators.ranking import last_rows, top_k
from recollect.sources.tables import numbered


def split_tiers(records: DataFrame, capacity: int = WORKING_CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The last ``capacity`` records are working memory, the others episodic."""
    working = last_rows(records, capacity, "id")
    return working, records.join(F.broadcast(working.select("id")), "id", "left_anti")  # at most `capacity` rows


def search_working(queries: DataFrame, working: DataFrame, k: int) -> DataFrame:
    """Keyword overlap; records without a shared token don't count.  Working memory is small by its capacity."""
    records = working.select("id", F.col("content"), tokens("content").alias("d"))
    asked = queries.select("query_id", tokens("text").alias("q"))
    scores = asked.crossJoin(F.broadcast(records)).withColumn("score", rounded(overlap(F.col("q"), F.col("d")) * TIER_WEIGHTS["working"]))
    return top_k(scores.where("score > 0"), ["query_id"], k).select("query_id", "id", F.lit("working").alias("tier"), "score", "rank", preview(F.col("content")).alias("preview"))


def _search(queries: DataFrame, entries: DataFrame, k: int, tier: str) -> DataFrame:
    found = search(queries, entries.select("id", F.col("content").alias("text")), 2 * k)
    fused = rrf_scores(found, knn(queries, entries, 2 * k)).join(entries.drop("embedding"), "id")
    weight = F.lit(TIER_WEIGHTS[tier])
    score = F.col("score") * weight * (1 + F.col("confidence") * 0.5) if tier == "semantic" else F.col("score") * weight
    found = fused.withColumn("score", rounded(score))
    return top_k(found, ["query_id"], k).select("query_id", "id", F.lit(tier).alias("tier"), "score", "rank", preview(F.col("content")).alias("preview"))


def search_semantic(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """entries: id, content, embedding, confidence."""
    return _search(queries, entries, k, "semantic")


def search_episodic(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """records: id, content, embedding."""
    return _search(queries, records, k, "episodic")


def search_lower_tiers(queries: DataFrame, semantic: DataFrame, episodic: DataFrame, k: int) -> DataFrame:
    """search_semantic and search_episodic together: one index with statistics by tier."""
    rows = semantic.select(F.lit("semantic").alias("tier"), "id", "content", "confidence", "embedding").unionByName(episodic.select(F.lit("episodic").alias("tier"), "id", "content", F.lit(0.0).alias("confidence"), "embedding"))
    found = search(queries, rows.select("tier", "id", F.col("content").alias("text")), 2 * k, by=["tier"]).select("tier", "query_id", "id", "rank")
    for tier, entries in (("semantic", semantic), ("episodic", episodic)):
        found = found.unionByName(knn(queries, entries, 2 * k).select(F.lit(tier).alias("tier"), "query_id", "id", "rank"))
    fused = found.groupBy("tier", "query_id", "id").agg(rounded(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank")))).alias("relevance"))
    weight = F.when(F.col("tier") == "semantic", TIER_WEIGHTS["semantic"] * (1 + F.col("confidence") * 0.5)).otherwise(TIER_WEIGHTS["episodic"])
    scored = fused.join(rows.select("tier", "id", "content", "confidence"), ["tier", "id"]).withColumn("score", rounded(F.col("relevance") * weight))
    return top_k(scored, ["tier", "query_id"], k).select("query_id", "id", "tier", "score", "rank", preview(F.col("content")).alias("preview"))


def merged(*results: DataFrame, k: int) -> DataFrame:
    """The k best over the tiers; ids of different tiers are different things."""
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "tier", "id")
    return found.withColumn("rank", F.row_number().over(window).cast("bigint")).where(F.col("rank") <= k)


def consolidation_window(records: DataFrame, batch: int = CONSOLIDATION_BATCH) -> DataFrame:
    """The last ``batch`` records where there are more than twice as many, else all."""
    last = last_rows(records, 2 * batch + 1, "id")
    # the last rows, how many of them there are, and so whether all rows are wanted
    few = last.agg(F.when(F.count("*") > 2 * batch, F.max("id")).alias("_many"))
    least = last_rows(records, batch, "id").agg(F.min("id").alias("_least"))
    bound = few.crossJoin(least).select(F.when(F.col("_many").isNotNull(), F.col("_least")).alias("_from"))  # one row
    return records.crossJoin(F.broadcast(bound)).where(F.col("_from").isNull() | (F.col("id") >= F.col("_from"))).drop("_from")


def clusters(records: DataFrame, roles: tuple[str, ...] | None = ("assistant", "tool_output")) -> DataFrame:
    """Records (id, role, content and what else they have) of dense roles with three tokens or more, with ``cluster``: their first two tokens."""
    rows = records.where(F.col("role").isin(list(roles))) if roles else records
    rows = rows.withColumn("_t", tokens("content")).where(F.size("_t") >= 3)
    return rows.withColumn("cluster", F.concat_ws("|", F.col("_t")[0], F.col("_t")[1])).drop("_t")


def consolidated(clustered: DataFrame) -> DataFrame:
    """One entry for every cluster of two or more: cluster, id (the least), source_count, source_ids, confidence, content (the longest; of equals the earliest)."""
    longest = F.max_by("content", F.struct(F.octet_length("content").alias("n"), (-F.col("id")).alias("i")))
    found = clustered.groupBy("cluster").agg(F.min("id").alias("id"), F.count("*").alias("source_count"), F.array_sort(F.collect_list("id")).alias("source_ids"), longest.alias("content"))
    return found.where("source_count >= 2").withColumn("confidence", F.least(F.lit(1.0), F.col("source_count") / 5.0))


def centroids(clustered: DataFrame) -> DataFrame:
    """cluster, embedding: the normalised sum of the members' embeddings, for clusters of two or more."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    members = clustered.where("embedding is not null").select("cluster", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), Summarizer.sum(F.col("v")).alias("v")).where("n >= 2")
    return sums.select("cluster", normalised(vector_to_array("v")).alias("embedding"))


def semantic_entries(clustered: DataFrame) -> DataFrame:
    return consolidated(clustered).join(centroids(clustered), "cluster")


def retention(records: DataFrame, now, half_life_ms: float = HALF_LIFE_MS):
    """Importance left at a time; times to come count as now."""
    return F.col("importance") * decay(now - F.col("ts_ms"), half_life_ms)


def survivors(records: DataFrame, now, below: float = FORGET_BELOW) -> DataFrame:
    """Records that aren't forgotten, with ``retention``."""
    return records.withColumn("retention", rounded(retention(records, now))).where(F.col("retention") >= below)


def horizons(records: DataFrame, now, days: tuple[int, ...] = (7, 30, 60, 90, 180), below: float = FORGET_BELOW) -> DataFrame:
    """days, evicted, remaining, rate: what is forgotten after that many days."""
    later = records.select("importance", "ts_ms", F.explode(F.array(*(F.lit(d).cast("bigint") for d in days))).alias("days"))
    left = rounded(retention(later, now + F.col("days") * 86_400_000))
    counted = later.withColumn("gone", (left < below).cast("bigint")).groupBy("days").agg(F.sum("gone").alias("evicted"), F.count("*").alias("n"))
    return counted.select("days", "evicted", (F.col("n") - F.col("evicted")).alias("remaining"), F.round(F.col("evicted") / F.col("n"), 8).alias("rate"))


def spills(adds: DataFrame, capacity: int = WORKING_CAPACITY, carry: Sequence[str] = ()) -> DataFrame:
    """start, added -> spills, spilled, working: what a working memory that held ``start`` has moved on after ``added`` more.

    Each time it holds capacity + 1 its oldest half moves, so the outcome has a closed form.
    """
    half = (capacity + 1) // 2
    held = F.col("start") + F.col("added")
    times = F.when(held <= capacity, 0).otherwise(1 + F.floor((held - (capacity + 1)) / half)).cast("bigint")
    return adds.select(*carry, "start", "added", times.alias("spills")).withColumn("spilled", F.col("spills") * half).withColumn("working", F.col("start") + F.col("added") - F.col("spilled"))


def new_session(working: DataFrame, episodic: DataFrame) -> DataFrame:
    """Episodic memory after all of working memory has moved there."""
    return episodic.unionByName(working)


# consolidation across runs

#: cluster, n, id (the least), ids, longest (size, -id, content), embedding (the sum)
def cluster_state(clustered: DataFrame) -> DataFrame:
    """What a run knows of its clusters; states of different records merge."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    content = F.struct(F.octet_length("content").alias("size"), (-F.col("id")).alias("order"), F.col("content").alias("content"))
    rows = clustered.where("embedding is not null").select("cluster", "id", content.alias("longest"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.collect_list("id").alias("ids"), F.max("longest").alias("longest"), Summarizer.sum(F.col("v")).alias("v"))
    return found.withColumn("embedding", vector_to_array("v")).drop("v")


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all records of states that share none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    found = states[0]
    for more in states[1:]:
        found = found.unionByName(more)
    found = found.withColumn("v", array_to_vector("embedding"))
    found = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.flatten(F.collect_list("ids")).alias("ids"), F.max("longest").alias("longest"), Summarizer.sum(F.col("v")).alias("v"))
    return found.withColumn("embedding", vector_to_array("v")).drop("v")


def run_entries(state: DataFrame, run: int) -> DataFrame:
    """The entries that a run adds: run, cluster, id (the least member), source_count, source_ids, confidence, content, embedding."""
    many = state.where("n >= 2")
    return many.select(
        F.lit(run).cast("bigint").alias("run"),
        "cluster",
        "id",
        F.col("n").alias("source_count"),
        F.array_sort("ids").alias("source_ids"),
        F.least(F.lit(1.0), F.col("n") / 5.0).alias("confidence"),
        F.col("longest.content").alias("content"),
        normalised(F.col("embedding")).alias("embedding"),
    )


def appended_entries(*runs_: DataFrame) -> DataFrame:
    """Entries of runs, one after the other, as they are appended: with ``entry``, numbered through all runs (within a run by the least member)."""
    found = runs_[0]
    for more in runs_[1:]:
        found = found.unionByName(more)
    return numbered(found, F.col("run") * (1 << 40) + F.floor(F.col("id") / 4096), ["id", "cluster"], "entry", top=F.floor(F.col("_bucket") / 4096))


def store_run(records: DataFrame, earlier: DataFrame | None, path: str, run: int) -> tuple[DataFrame, DataFrame]:
    """One run over new records: the merged state and the entries that the run adds, both written to ``path``.

    ``earlier``: the state after the run before; its records aren't read again.
    """
    spark = records.sparkSession
    own = cluster_state(records)
    (own if earlier is None else merged_states(earlier, own)).write.parquet(f"{path}/state-{run}")
    state = spark.read.parquet(f"{path}/state-{run}")
    run_entries(state, run).write.parquet(f"{path}/entries-{run}")
    return state, spark.read.parquet(f"{path}/entries-{run}")
