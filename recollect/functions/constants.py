"""Defaults that results depend on (fixed values)."""

K1, B = 1.2, 0.75
RRF_K = 60
TOP_K, CANDIDATES = 10, 100
DAY_MS = 86_400_000
HALF_LIFE_MS = 30 * DAY_MS
#: The logarithm of 2 to six digits; decay uses this literal.
LN2 = 0.693147
IMPORTANCE_SHARE = 0.5
WEEK_MS, MOST_BUCKETS, EARLY_STOP = 604_800_000, 4, 0.8
WORKING_CAPACITY = 100
TIER_WEIGHTS = {"working": 1.5, "semantic": 1.2, "episodic": 1.0}
FORGET_BELOW, CONSOLIDATION_BATCH = 0.05, 100
PREVIEW = 80
FIRST_TS, SESSION_MS, TURN_MS = 1_704_067_200_000, 3_600_000, 15_000
IMPORTANCE = {"system": 0.3, "user": 0.7, "planning": 0.4, "tool_call": 0.5, "tool_output": 0.6, "assistant": 0.8}
ROLES = ["user", "assistant", "tool_call", "tool_output", "system", "planning", "observation"]
TOOLS = ["", "web_search", "code_exec", "file_read", "file_write", "api_call", "db_query", "shell_cmd", "calculator", "memory_read"]
TIERS = ["working", "semantic", "episodic"]
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into through during before after and but or nor not so yet it its this that these those"
).split()
