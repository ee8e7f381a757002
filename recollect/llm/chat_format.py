"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

A pair of conversations shares its longest common turn prefix: the turns, from the first
on, whose role and text agree on both sides.  The prefix is rendered once as the prompt;
what remains of either side is its completion.  A completion's mask lists the character
spans [start, end) that a loss counts: the text of the assistant's turns with the end
mark, never the headers or other roles' turns.

Turns are matched by an aggregation over (pair, position), so a pair's two sides meet
turn by turn and no turn is compared with any but its counterpart.

Defined results: turns with a null key or position are left out; a null role counts as
``user`` and a null text as empty; turns that repeat (same conversation and position) keep
the least (role, text); positions need not be consecutive, they only order the turns; a
pair without one of its sides keeps the other, with an empty prompt and null for what is
missing; extra columns are ignored.  A pair is one row, as its results are: prompt and
completions are texts, so a pair's conversations must fit a row (2 GB at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: The rendering of a turn: header, text, end mark (fixed values).
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def conversation_turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """conversation, n (from 1), role, text: one row per turn, in order."""
    turns = conversations.select(F.col(key).alias("conversation"), F.col(turn).alias("position"), F.struct(F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said"))
    turns = turns.where("conversation is not null and position is not null").groupBy("conversation", "position").agg(F.min("said").alias("said"))
    return turns.withColumn("n", F.row_number().over(Window.partitionBy("conversation").orderBy("position"))).select("conversation", "n", "said.role", "said.text")


def _side(chosen: bool) -> Column:
    return F.max(F.when(F.col("chosen") == chosen, F.struct("role", "text")))


def preference_pairs(turns: DataFrame, completion_role: str = "assistant") -> DataFrame:
    """Pairs from turns with columns pair, chosen (boolean), conversation, n, role, text.

    One row per pair: the conversations, n_common, prompt, and for either side the
    completion and its mask.
    """
    met = turns.groupBy("pair", "n").agg(_side(True).alias("c"), _side(False).alias("r"), F.max(F.when(F.col("chosen"), F.col("conversation"))).alias("cc"), F.max(F.when(~F.col("chosen"), F.col("conversation"))).alias("rc"))
    met = met.withColumn("same", F.coalesce(F.col("c") == F.col("r"), F.lit(False)))
    pairs = met.groupBy("pair").agg(
        F.max("cc").alias("chosen_id"),
        F.max("rc").alias("rejected_id"),
        F.min(F.when(~F.col("same"), F.col("n"))).alias("differ"),
        F.array_sort(F.collect_list(F.struct("n", "c", "r"))).alias("turns"),
    )
    n_common = F.coalesce(F.col("differ") - 1, F.size("turns")).cast("bigint")
    pairs = pairs.withColumn("n_common", n_common)
    common = F.filter("turns", lambda t: t["n"] <= F.col("n_common"))
    rest = F.filter("turns", lambda t: t["n"] > F.col("n_common"))
    out = pairs.select("pair", "chosen_id", "rejected_id", "n_common", F.array_join(F.transform(common, lambda t: rendered(t["c"])), "").alias("prompt"), rest.alias("rest"))
    for side, field in (("chosen", "c"), ("rejected", "r")):
        own = F.filter(F.transform("rest", lambda t: t[field]), lambda t: t.isNotNull())
        out = out.withColumn(f"{side}_turns", own)
    for side in ("chosen", "rejected"):
        turns_ = F.col(f"{side}_turns")
        missing = F.col(f"{side}_id").isNull()
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))

        def add(done: Column, t: Column) -> Column:
            begin = done["at"] + F.length(t["role"]) + len(OPEN + AFTER_ROLE)
            end = begin + F.length(t["text"]) + len(CLOSE)
            masked = F.when(t["role"] == completion_role, F.concat(done["spans"], F.array(F.array(begin, end)))).otherwise(done["spans"])
            return F.struct(end.alias("at"), masked.alias("spans"))

        out = out.withColumn(f"{side}_completion", F.when(~missing, F.array_join(F.transform(turns_, rendered), "")))
        out = out.withColumn(f"{side}_mask", F.when(~missing, F.aggregate(turns_, start, add, lambda done: done["spans"])))
    return out.drop("rest", "chosen_turns", "rejected_turns")


def neighbours(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of conversations in pairs: 2k is chosen over 2k + 1."""
    turns = conversation_turns(conversations, key, turn, role, text)
    return turns.select(F.floor(F.col("conversation") / 2).alias("pair"), (F.pmod("conversation", F.lit(2)) == 0).alias("chosen"), "conversation", "n", "role", "text")
