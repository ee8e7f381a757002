"""The registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.functions import scores, text, vectors
from recollect.functions.constants import DAY_MS, ROLES, TIERS, TOOLS, TOP_K
from recollect.operators import blocks, cells, dense, fusion, lexical, metrics, ranking, runs, temporal, tiers
from recollect.sources import synthetic, tables
from recollect.streaming import staging, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.build_index(_docs(spark, d))


def _shared(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top}/recollect-{uuid.uuid4().hex}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


# text and index


@query
def tokenize_stats(spark, d):
    t = _docs(spark, d).select("id", text.tokens("text").alias("t"))
    return t.select(F.col("id").alias("doc_id"), F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query
def term_frequency(spark, d):
    c = lexical.term_counts(_docs(spark, d))
    return c.select(F.col("id").alias("doc_id"), "term", "n", scores.rounded(F.col("n") / F.col("length")).alias("tf"))


@query
def doc_lengths(spark, d):
    return _index(spark, d).lengths.select(F.col("id").alias("doc_id"), "length")


@query
def corpus_stats(spark, d):
    return _index(spark, d).corpus.select("n", F.round("mean_length", 8).alias("mean_length"))


@query
def term_idf(spark, d):
    return _index(spark, d).terms.select("term", "df", scores.rounded(F.col("idf")).alias("idf"))


@query
def postings(spark, d):
    return _index(spark, d).postings.select("term", F.col("id").alias("doc_id"), scores.rounded(F.col("tf")).alias("tf"), scores.rounded(F.col("weight")).alias("weight"))


@query
def term_max_score(spark, d):
    return lexical.max_weights(_index(spark, d))


@query
def csr_offsets(spark, d):
    return lexical.csr(_index(spark, d)).select("term", "term_id", "df", F.col("first").alias("first_posting"))


@query
def maxscore_bounds(spark, d):
    return lexical.remaining_bounds(_asked(spark, d), _index(spark, d))


@query
def maxscore_skips(spark, d):
    docs, asked = _docs(spark, d), _asked(spark, d)
    return lexical.skip_stats(asked, lexical.build_index(docs, wanted=lexical.query_terms(asked).select("term").distinct()), TOP_K)


def _stored(spark, d):
    return blocks.store_index(_docs(spark, d), f"{_shared(spark)}/index")


@query
def bm25_pruned_topk(spark, d):
    """The rows of bm25_topk, from stored blocks of which most stay unread."""
    return _hits(_stored(spark, d).search(_asked(spark, d), TOP_K))


@query
def bm25_pruned_work(spark, d):
    """query_id, postings of its terms; fewer: whether that is what a search decodes at most."""
    work = _stored(spark, d).work(_asked(spark, d), TOP_K)
    return work.select("query_id", "postings", (F.col("decoded") <= F.col("postings")).alias("fewer"))


@query
def stored_csr_offsets(spark, d):
    return _stored(spark, d).offsets().select("term", "term_id", "df", F.col("first").alias("first_posting"))


@query
def stored_term_lookup(spark, d):
    """The postings of the term that most documents have, read from its slices."""
    index = _stored(spark, d)
    term = [r["term"] for r in index.offsets().orderBy(F.desc("df"), "term").limit(1).collect()]
    return index.postings(term[0] if term else "").select(F.col("id").alias("doc_id"), scores.rounded(F.col("weight")).alias("weight"))


@query
def bm25_topk(spark, d):
    return _hits(lexical.search(_asked(spark, d), _docs(spark, d), TOP_K))


@query
def bm25_repeated_query_terms(spark, d):
    twice = _asked(spark, d).withColumn("text", F.concat_ws(" ", "text", F.substring_index("text", " ", 3)))
    return _hits(lexical.search(twice, _docs(spark, d), TOP_K))


@query
def global_topk(spark, d):
    docs, asked = _docs(spark, d), _asked(spark, d)
    index = lexical.build_index(docs, wanted=lexical.query_terms(asked).select("term").distinct())
    best = ranking.global_top(lexical.bm25_scores(asked, index), 50, ties=["query_id", "id"])
    return best.select("query_id", F.col("id").alias("doc_id"), "score")


# vectors


@query
def knn_topk(spark, d):
    return _hits(dense.knn(tables.queries(spark, d), tables.documents(spark, d), TOP_K))


def _cells(spark, d):
    v = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), cells.store_cells(v, f"{_shared(spark)}/cells")


@query
def knn_cells(spark, d):
    """Approximate neighbours: codes choose the vectors that are compared."""
    _, asked, index = _cells(spark, d)
    return index.search(asked, TOP_K).withColumnRenamed("id", "vec_id")


@query
def knn_cells_quality(spark, d):
    """Of every query: nine of its ten nearest are found, and less than a fifth of the vectors are compared."""
    v, asked, index = _cells(spark, d)
    near = dense.knn(asked, v, TOP_K).join(index.search(asked, TOP_K).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    found = near.groupBy("query_id").agg((F.count("hit") >= 0.9 * F.count("*")).alias("found"))
    n = v.agg(F.count("*").alias("n"))
    work = index.work(asked, TOP_K).crossJoin(F.broadcast(n))  # one row
    return found.join(work.select("query_id", (F.col("compared") < 0.2 * F.col("n")).alias("pruned")), "query_id")


@query
def vector_normalize(spark, d):
    v = tables.table(spark, d, "embeddings").withColumn("scaled", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)))
    unit = vectors.normalised(F.col("scaled"))
    return v.select("vec_id", F.round(F.sqrt(vectors.squared_norm(F.col("scaled"))), 6).alias("norm"), F.round(vectors.squared_norm(unit), 6).alias("unit_norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("component_sum"))


@query
def vector_add(spark, d):
    v = tables.table(spark, d, "embeddings")
    both = v.select("vec_id", vectors.added(F.col("embedding"), F.reverse("embedding")).alias("s"))
    return both.select("vec_id", F.size("s").cast("bigint").alias("dim"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"))


# fusion


def _lists(spark, d, k=100):
    return lexical.search(_asked(spark, d), _docs(spark, d), k), dense.knn(tables.queries(spark, d), tables.documents(spark, d), k)


@query
def rrf_fusion(spark, d):
    return _hits(fusion.rrf(*_lists(spark, d), top=TOP_K))


@query
def rrf_custom_k(spark, d):
    return _hits(fusion.rrf(*_lists(spark, d), top=TOP_K, k=10))


# filters, recency, importance


def _records(spark, d):
    return tables.memory_records(spark, d)


@query
def filter_session(spark, d):
    return _records(spark, d).where("session_id = 'sess-000003'").select("id", "session_id", "role", "ts_ms")


@query
def filter_agent(spark, d):
    return _records(spark, d).where("agent_id = 2").select("id", "agent_id", "role")


@query
def filter_role(spark, d):
    return _records(spark, d).where(F.col("role").isin("assistant", "tool_output")).select("id", "role")


@query
def filter_time_range(spark, d):
    return _records(spark, d).where(F.col("ts_ms").between(1704067200000 + 5 * 3600000, 1704067200000 + 20 * 3600000)).select("id", "ts_ms")


@query
def filter_min_tokens(spark, d):
    return _records(spark, d).where(F.size(text.tokens("content")) >= 3).select("id")


@query
def point_lookup(spark, d):
    return tables.lookup(_records(spark, d), 7).select("id", "session_id", "role", "importance")


def _memory_queries(spark, d):
    """Benchmark items as queries with filters that depend on the item's number."""
    i = F.col("query_id")
    return tables.queries(spark, d).select(
        "query_id",
        "text",
        "embedding",
        F.when(i % 7 == 1, F.format_string("sess-%06d", i)).alias("session_filter"),
        F.when(i % 5 == 2, i % 6).alias("agent_filter"),
        F.when(i % 3 == 0, "assistant").alias("role_filter"),
        F.when(i % 4 == 1, 1704067200000 + i * 3600000).alias("time_start"),
        F.when(i % 4 == 1, 1704067200000 + (i + 20) * 3600000).alias("time_end"),
        (F.lit(0.1) * (i % 5)).alias("recency_weight"),
    )


def _memory_lists(spark, d):
    records = tables.memory_records(spark, d, embeddings=True)
    asked = _memory_queries(spark, d)
    return asked, records, lexical.search(asked, records.select("id", F.col("content").alias("text")), 100), dense.knn(asked, records, 100)


@query
def post_filter_rrf(spark, d):
    asked, records, sparse, near = _memory_lists(spark, d)
    kept = [fusion.kept_candidates(x, asked, records) for x in (sparse, near)]
    return fusion.rrf(*kept, top=TOP_K)


@query
def memory_fuse(spark, d):
    asked, records, sparse, near = _memory_lists(spark, d)
    records = records.crossJoin(F.broadcast(records.agg(F.max("ts_ms").alias("now"))))  # one row
    return fusion.memory_fuse(sparse, near, asked, records, F.col("now"), top=TOP_K)


@query
def filter_matches(spark, d):
    """Of every query how many records pass its filter, the first and the last of them."""
    found = fusion.matches(_memory_queries(spark, d), _records(spark, d))
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def recency_decay(spark, d):
    now = 1706745600000
    e = tables.event_records(spark, d)
    recency = scores.decay(F.lit(now) - F.col("ts_ms"))
    return e.select("id", scores.rounded(recency).alias("recency"), scores.rounded(scores.blended(F.col("importance"), recency, F.lit(0.3))).alias("blended"))


@query
def importance_boost(spark, d):
    return _records(spark, d).select("id", scores.rounded(scores.boosted(F.lit(1.0) / (F.lit(60) + F.col("id")), F.col("importance"))).alias("score"))


# time


@query
def temporal_buckets(spark, d):
    return temporal.bucketed(tables.event_records(spark, d)).groupBy("bucket").agg(F.count("*").alias("records"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


def _daily(spark, d):
    return temporal.bucketed(_records(spark, d), DAY_MS).select("id", F.col("content").alias("text"), "ts_ms", "bucket")


def _stored_search(spark, d):
    folder = _shared(spark)
    temporal.store_by_bucket(_daily(spark, d), f"{folder}/buckets")
    return temporal.search_stored(spark, _asked(spark, d), f"{folder}/buckets", f"{folder}/steps", 5, threshold=0.6), spark.read.parquet(f"{folder}/buckets")


@query
def temporal_topk_early_stop(spark, d):
    """From a table that is stored by day: older days are read for the queries that need them."""
    return _stored_search(spark, d)[0].results()


@query
def temporal_topk_fixed(spark, d):
    return temporal.search_fixed(_asked(spark, d), _daily(spark, d), 5)


@query
def temporal_search_stats(spark, d):
    found, stored = _stored_search(spark, d)
    return found.stats(stored.count())


@query
def temporal_search_averages(spark, d):
    found, stored = _stored_search(spark, d)
    return temporal.mean_stats(found.stats(stored.count()))


@query
def weekly_windows(spark, d):
    e = tables.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("role"))
    return store.windowed_counts(e).select(F.unix_millis("start").alias("start_ms"), "role", "n")


# tiers


def _tiers(spark, d):
    return tables.queries(spark, d), *tiers.split_tiers(tables.memory_records(spark, d, embeddings=True))


def _entries(spark, d):
    docs = tables.documents(spark, d).select("id", F.col("text").alias("content"), F.lit("assistant").alias("role"), "embedding")
    return tiers.clusters(docs)


_TIER = ["query_id", "id", "tier", "score", "rank"]


@query
def working_overlap(spark, d):
    asked, working, _ = _tiers(spark, d)
    return tiers.search_working(asked, working, TOP_K).select(*_TIER, "preview")


@query
def semantic_search(spark, d):
    return tiers.search_semantic(tables.queries(spark, d), tiers.semantic_entries(_entries(spark, d)), TOP_K).select(_TIER)


@query
def episodic_search(spark, d):
    asked, _, episodic = _tiers(spark, d)
    return tiers.search_episodic(asked, episodic, TOP_K).select(_TIER)


def _all_tiers(spark, d):
    """Semantic entries and records are written, as a memory keeps them, and then searched."""
    folder = _shared(spark)
    tiers.semantic_entries(_entries(spark, d)).drop("source_ids").write.parquet(f"{folder}/semantic")
    tables.memory_records(spark, d, embeddings=True).write.parquet(f"{folder}/records")
    working, episodic = tiers.split_tiers(spark.read.parquet(f"{folder}/records"))
    asked = tables.queries(spark, d)
    return tiers.merged(tiers.search_working(asked, working, TOP_K), tiers.search_lower_tiers(asked, spark.read.parquet(f"{folder}/semantic"), episodic, TOP_K), k=15)


@query
def tier_merge(spark, d):
    return _all_tiers(spark, d).select(_TIER)


@query
def tier_counts(spark, d):
    return metrics.tier_counts(_all_tiers(spark, d))


@query
def consolidate_clusters(spark, d):
    c = tiers.consolidated(_entries(spark, d))
    return c.select("cluster", "id", "source_count", F.concat_ws(",", F.col("source_ids").cast("array<string>")).alias("source_ids"), F.md5("content").alias("content_md5"), F.round("confidence", 8).alias("confidence"))


@query
def consolidate_centroids(spark, d):
    c = tiers.centroids(_entries(spark, d))
    return c.select("cluster", F.size("embedding").cast("bigint").alias("dim"), F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("component_sum"))


@query
def consolidate_two_runs(spark, d):
    """Two runs: over the documents with even ids, and over all when the others have come."""
    folder, entries = _shared(spark), _entries(spark, d)
    state, first = tiers.store_run(entries.where("id % 2 = 0"), None, folder, 0)
    _, second = tiers.store_run(entries.where("id % 2 = 1"), state, folder, 1)
    found = tiers.appended_entries(first, second)
    return found.select("entry", "run", "cluster", "id", "source_count", F.md5("content").alias("content_md5"), F.round("confidence", 8).alias("confidence"), F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x), 6).alias("component_sum"))


@query
def consolidation_window(spark, d):
    return tiers.consolidation_window(_records(spark, d), 40).select("id")


@query
def decay_survivors(spark, d):
    s = tiers.survivors(tables.event_records(spark, d), F.lit(1706745600000 + 90 * DAY_MS))
    return tables.numbered(s, F.floor(F.col("id") / 4096), ["id"], "position").select("id", "position", "retention")


@query
def decay_horizons(spark, d):
    return tiers.horizons(tables.event_records(spark, d), F.lit(1706745600000))


@query
def spill_schedule(spark, d):
    """For every session: what has moved on of a working memory of ten after the session's turns, of which its number modulo 11 were there before."""
    turns = tables.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    adds = turns.select("conv_id", F.least(F.pmod("conv_id", F.lit(11)), "n").alias("start"), (F.col("n") * 3).alias("added"))
    return tiers.spills(adds, 10, carry=["conv_id"])


def _waiting(spark, d, rows):
    """A stream of rows that wait as JSON files."""
    folder = _shared(spark)
    rows.write.json(f"{folder}/waiting")
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", staging.STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return folder, session.readStream.schema(rows.schema).json(f"{folder}/waiting")


def _streamed(spark, folder, stream):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def staged_flushes(spark, d):
    """Events stream into a staging area for each type, which lets go 1,000 at a time."""
    folder, events = _waiting(spark, d, tables.event_records(spark, d).select("id", F.col("role").alias("store"), "ts_ms"))
    found = _streamed(spark, folder, staging.flushes(events, key="store"))
    return found.groupBy("store", "flush").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def spilled_tiers(spark, d):
    """Turns stream into the working memory of their agent, which holds twenty; where they end up."""
    folder, turns = _waiting(spark, d, _records(spark, d).select("id", "agent_id", "ts_ms"))
    found = staging.present_tiers(_streamed(spark, folder, staging.tier_changes(turns, capacity=20)))
    return found.select(F.col("agent").cast("bigint").alias("agent_id"), "id", "tier")


@query
def session_runs(spark, d):
    """Runs of one user's events in the order of time."""
    found = runs.runs(tables.event_records(spark, d), ["ts_ms", "id"], "session_id", f"{_shared(spark)}/runs")
    return found.select("run", F.col("value").alias("session_id"), F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"), "n")


@query
def new_session_flush(spark, d):
    working, episodic = tiers.split_tiers(_records(spark, d))
    return tiers.new_session(working, episodic).groupBy("session_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


# overviews


@query
def store_overview(spark, d):
    return metrics.overview(_records(spark, d))


@query
def records_by_role(spark, d):
    return metrics.counts_by(_records(spark, d), "role")


@query
def records_by_agent(spark, d):
    return metrics.counts_by(_records(spark, d), "agent_id")


@query
def records_by_tool(spark, d):
    """The assistant's turns use the tools in turn."""
    tool = text.named(F.when(F.col("role") == "assistant", F.col("id") % len(TOOLS)).otherwise(0), TOOLS)
    return metrics.counts_by(_records(spark, d).withColumn("tool", tool), "tool")


@query
def distinct_sessions(spark, d):
    return _records(spark, d).select("session_id").distinct()


@query
def session_sample(spark, d):
    r = _records(spark, d)
    first = r.where("session_id = 'sess-000000'").orderBy("id").limit(6)
    return first.select("id", "role", text.shortened(F.col("content"), 40).alias("content"))


@query
def role_names(spark, d):
    """Names of codes, some beyond the list: every record's number modulo 9."""
    return _records(spark, d).select("id", text.named(F.col("id") % 9, ROLES).alias("role"))


@query
def tool_and_tier_names(spark, d):
    return _records(spark, d).select("id", text.named(F.col("id") % 12, TOOLS).alias("tool"), text.named(F.col("id") % 5, TIERS).alias("tier"))


@query
def durations(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.duration(F.col("l_orderkey") * 40.0).alias("duration"))


# evaluation


@query
def kendall_tau(spark, d):
    a = lexical.search(_asked(spark, d), _docs(spark, d), 20)
    b = fusion.rrf(a, dense.knn(tables.queries(spark, d), tables.documents(spark, d), 20), top=20)
    return ranking.kendall_tau(a, b)


@query
def match_rate(spark, d):
    a = lexical.search(_asked(spark, d), _docs(spark, d), TOP_K)
    b = fusion.rrf(a, dense.knn(tables.queries(spark, d), tables.documents(spark, d), TOP_K), top=TOP_K)
    return ranking.match_rates(a, b)


def _runs(spark, d):
    """Events as runs of a benchmark: the type is the strategy, the user the corpus, and the mean value (in cents, whole) the time."""
    kind = F.when(F.col("event_type") == "view", "sequential").when(F.col("event_type") == "click", "data_parallel").otherwise("full_parallel")
    threads = F.when(F.col("event_type") == "view", 1).otherwise(F.pow(F.lit(2), F.pmod("event_id", F.lit(3)) + 1)).cast("bigint")
    rows = tables.table(spark, d, "events").where("value is not null").select(((F.pmod("user_id", F.lit(4)) + 1) * 1000).alias("corpus_size"), kind.alias("strategy"), threads.alias("threads"), (F.floor(F.col("value") * 100) + 1).alias("cents"))
    return rows.groupBy("corpus_size", "strategy", "threads").agg((F.sum("cents") / F.count("*")).alias("total_ms"), F.count("*").alias("num_queries"))


@query
def amdahl(spark, d):
    return metrics.amdahl_table(_runs(spark, d))


@query
def speedup_efficiency(spark, d):
    return metrics.speedups(_runs(spark, d))


@query
def best_runs(spark, d):
    return metrics.best_runs(_runs(spark, d))


@query
def scaling_pivot(spark, d):
    return metrics.pivoted(_runs(spark, d), ["sequential", "data_parallel", "full_parallel"])


@query
def mean_timings(spark, d):
    return metrics.mean_timings(_runs(spark, d))


# writing


@query
def stream_append_snapshot(spark, d):
    """Conversations through the stream into a store, then searched in the snapshot."""
    folder = _shared(spark)
    _records(spark, d).withColumnRenamed("id", "source_id").withColumn("agent_id", F.col("agent_id").cast("string")).drop("tool").write.json(f"{folder}/waiting")
    store.append_stream(spark, f"{folder}/waiting", f"{folder}/store", f"{folder}/state").awaitTermination()
    return store.Store(spark, f"{folder}/store").search(_asked(spark, d), TOP_K).select("query_id", "id", "score", "rank")


@query
def segments_search(spark, d):
    """Conversations in five flushes, of which the first three are compacted: a search over the segments."""
    s = store.Store(spark, f"{_shared(spark)}/store")
    records = _records(spark, d).withColumnRenamed("id", "source_id").withColumn("agent_id", F.col("agent_id").cast("string")).drop("tool")
    for part in range(5):
        s.flush(records.where(F.col("source_id") % 5 == part), part)
        if part == 2:
            s.compact()
    return s.search(_asked(spark, d), TOP_K).select("query_id", "id", "score", "rank")


@query
def stream_reads_beside_writes(spark, d):
    """Quarters of the conversations arrive one after the other; a reader looks while each is flushed, and after."""
    folder, seen = _shared(spark), []
    records = _records(spark, d).withColumnRenamed("id", "source_id").withColumn("agent_id", F.col("agent_id").cast("string")).drop("tool")
    for part in range(4):
        records.where(F.col("source_id") % 4 == part).write.mode("append").json(f"{folder}/waiting")
        before = store.snapshot(spark, f"{folder}/store").count()
        writer = store.append_stream(spark, f"{folder}/waiting", f"{folder}/store", f"{folder}/state")
        during = store.snapshot(spark, f"{folder}/store").count()
        writer.awaitTermination()
        after = store.snapshot(spark, f"{folder}/store").count()
        seen.append((part, after, during in (before, after)))
    return spark.createDataFrame(seen, "flush long, visible long, whole boolean")


@query
def csv_round_trip(spark, d):
    folder = _shared(spark)
    tables.write_csv(metrics.speedups(_runs(spark, d)), f"{folder}/runs")
    return tables.read_csv(spark, f"{folder}/runs", "corpus_size bigint, strategy string, threads bigint, speedup double, efficiency double")


@query
def csv_append(spark, d):
    """Customers with odd numbers go behind the others."""
    folder, rows = _shared(spark), tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    for odd in (0, 1):
        tables.write_csv(rows.where(F.col("c_custkey") % 2 == odd), f"{folder}/customers", append=odd == 1, digits=2)
    return tables.read_csv(spark, f"{folder}/customers", "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


# synthetic sources: a row for each row of a table, of the words of its documents


@query
def generic_corpus(spark, d):
    docs = tables.table(spark, d, "documents")
    made = synthetic.corpus(docs.select(F.col("doc_id").alias("id")), vocab=synthetic.frequent_words(docs))
    return made.select("id", F.size(F.split("text", " ")).cast("bigint").alias("n_words"), F.md5("text").alias("text_md5"), F.round(vectors.squared_norm(F.col("embedding")), 6).alias("norm"))


@query
def generic_queries(spark, d):
    asked = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    made = synthetic.corpus_queries(asked, vocab=synthetic.frequent_words(tables.table(spark, d, "documents")))
    return made.select("query_id", "text", F.round(vectors.squared_norm(F.col("embedding")), 6).alias("norm"))


def _agents(spark, d):
    return synthetic.agent_records(tables.table(spark, d, "conversations").select(F.col("conv_id").alias("s")).distinct())


@query
def agent_corpus(spark, d):
    return _agents(spark, d).select("id", "session_id", "agent_id", "role", "tool", "ts_ms", "content", "importance")


@query
def agent_queries(spark, d):
    asked = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return synthetic.agent_queries(asked, _agents(spark, d)).select("query_id", "text", "session_filter", "time_start", "time_end", "recency_weight", F.col("top_k").cast("bigint").alias("top_k"))
