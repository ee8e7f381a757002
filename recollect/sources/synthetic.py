"""Synthetic corpora and queries over the rows of a table.

Picks follow from row numbers by whole-number arithmetic, so any task can make any row and
other engines can make the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.constants import DAY_MS, FIRST_TS, IMPORTANCE, SESSION_MS, TURN_MS
from recollect.functions.text import tokens
from recollect.functions.vectors import normalised
from recollect.sources.tables import numbered

SEED, WORDS, QUERY_WORDS, DIM = 42, 50, 5, 128
AGENTS = 6
TOPICS = ["search", "debugging", "deployment", "analysis"]


def vocabulary(size: int = 202) -> list[str]:
    """Distinct words of two syllables, by a rule."""
    syllables = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    return [syllables[i % 60] + syllables[(i * 7 + i // 60) % 60] for i in range(size)]


def pick(seed: int, *key: Column, n: int | Column) -> Column:
    """A whole number below n for a key of whole numbers: a linear congruence for each, and two more."""
    x = F.lit(seed).cast("bigint")
    for k in (*key, F.lit(0), F.lit(0)):
        x = F.pmod(x * 1_103_515_245 + k + 12_345, F.lit(1 << 31))
    return (F.floor(x / 256) % n).cast("int")


def pseudo_embedding(key: Column, dim: int = DIM) -> Column:
    """A unit vector that depends on the key alone: equal texts, equal vectors."""
    part = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(2_000_001)).cast("double") / 1_000_000 - 1)
    return normalised(part)


def frequent_words(docs: DataFrame, n: int = 202) -> list[str]:
    """The n tokens of docs (text) that most documents have."""
    each = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("word"))
    return [r["word"] for r in each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()]


def random_texts(rows: DataFrame, words: int, seed: int, name: str, vocab: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """name, text, embedding for every row (a whole-number column ``name``)."""
    vocab = vocab or vocabulary()
    choices = F.array(*map(F.lit, vocab))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.element_at(choices, pick(seed, F.col(name), i, n=len(vocab)) + 1)), " ")
    return rows.select(name, text.alias("text")).withColumn("embedding", pseudo_embedding(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")), dim))


def corpus(rows: DataFrame, words: int = WORDS, **options) -> DataFrame:
    return random_texts(rows, words, SEED, "id", **options)


def corpus_queries(rows: DataFrame, words: int = QUERY_WORDS, **options) -> DataFrame:
    return random_texts(rows, words, SEED + 999_999, "query_id", **options)


def agent_records(sessions: DataFrame, turns: int = 8, dim: int = DIM) -> DataFrame:
    """Sessions (s, whole numbers) of agents with tools: a system turn, then rounds of user, planning (every other round), tool call, tool output and assistant.

    A session has between half and one and a half times ``turns`` turns.
    """
    size = F.lit(turns // 2) + pick(SEED, F.col("s"), n=turns + turns // 2 - turns // 2 + 1)
    rounds = F.sequence(F.lit(0), F.lit(turns + turns // 2))
    plan = lambda r: pick(SEED + 1, F.col("s"), r, n=2) == 0
    every = [F.array(*map(F.lit, ["user", "planning", "tool_call", "tool_output", "assistant"])), F.array(*map(F.lit, ["user", "tool_call", "tool_output", "assistant"]))]
    roles = F.concat(F.array(F.lit("system")), F.flatten(F.transform(rounds, lambda r: F.when(plan(r), every[0]).otherwise(every[1]))))
    base = sessions.select("s").withColumn("roles", F.slice(roles, F.lit(1), F.greatest(F.lit(1), size)))
    said = base.select("s", F.posexplode("roles").alias("turn", "role"))
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("s") % len(TOPICS) + 1).cast("int"))
    tool = F.when(F.col("role").isin("tool_call", "tool_output"), F.element_at(F.array(*map(F.lit, ["web_search", "code_exec", "shell_cmd", "db_query"])), (F.col("s") % 4 + 1).cast("int"))).otherwise("")
    variant = pick(SEED + 2, F.col("s"), F.col("turn"), n=3)
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in IMPORTANCE.items() for x in pair)), F.col("role"))
    rows = said.select(
        "s",
        "turn",
        F.format_string("sess-%06d", "s").alias("session_id"),
        F.format_string("agent-%02d", (F.col("s") % AGENTS + 1).cast("int")).alias("agent_id"),
        "role",
        tool.alias("tool"),
        (F.lit(FIRST_TS) + F.col("s") * SESSION_MS + F.col("turn") * TURN_MS).alias("ts_ms"),
        F.concat_ws(" ", topic, F.col("role"), F.format_string("note %d", variant)).alias("content"),
        weight.alias("importance"),
    )
    out = numbered(rows, F.floor(F.col("s") / 4096), ["s", "turn"])
    return out.select("id", "session_id", "agent_id", "role", "tool", "ts_ms", "content", pseudo_embedding(F.col("content"), dim).alias("embedding"), "importance")


def agent_queries(queries: DataFrame, records: DataFrame, recency_weight: float = 0.3, top_k: int = 10, dim: int = DIM) -> DataFrame:
    """For each query (query_id) one over the topics in turn: three in ten name a session, two in ten ask for the last seven days."""
    end = records.agg(F.max("ts_ms").alias("end"), F.countDistinct("session_id").alias("sessions"))
    rows = queries.select("query_id").crossJoin(F.broadcast(end))  # one row
    text = F.concat(F.lit("find earlier notes about "), F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("query_id") % len(TOPICS) + 1).cast("int")))
    recent = pick(SEED + 4, F.col("query_id"), n=10) < 2
    session = F.when(pick(SEED + 3, F.col("query_id"), n=10) < 3, F.format_string("sess-%06d", pick(SEED + 5, F.col("query_id"), n=F.col("sessions"))))
    return rows.select("query_id", text.alias("text"), pseudo_embedding(text, dim).alias("embedding"), session.alias("session_filter"), F.lit(None).cast("string").alias("agent_filter"), F.lit(None).cast("string").alias("role_filter"), F.when(recent, F.col("end") - 7 * DAY_MS).alias("time_start"), F.when(recent, F.col("end")).alias("time_end"), F.lit(recency_weight).alias("recency_weight"), F.lit(top_k).alias("top_k"))
