"""SQL (DuckDB) for the same rows as the registered queries, written on its own."""

from __future__ import annotations

from recollect.functions.constants import ROLES, STOPWORDS, TIERS, TOOLS
from recollect.sources.synthetic import SEED, TOPICS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

TOOL_LIST, TIER_LIST = ("[" + ", ".join(f"'{w}'" for w in names) + "]" for names in (TOOLS, TIERS))


def tok(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))"


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
VEC = "nv AS (SELECT count(*) AS n FROM embeddings)"
DOCV = f"{VEC}, docv AS (SELECT doc_id AS id, text, embedding FROM documents, nv JOIN embeddings ON vec_id = doc_id % n)"
ASKV = "askv AS (SELECT item_id AS query_id, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"
MEM = """mem AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, printf('sess-%06d', conv_id) AS session_id, conv_id % 6 AS agent_id, role,
  1704067200000 + conv_id * 3600000 + turn * 15000 AS ts_ms, text AS content,
  CASE role WHEN 'system' THEN 0.3::DOUBLE WHEN 'user' THEN 0.7::DOUBLE WHEN 'planning' THEN 0.4::DOUBLE WHEN 'tool_call' THEN 0.5::DOUBLE WHEN 'tool_output' THEN 0.6::DOUBLE WHEN 'assistant' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS importance FROM conversations)"""
EV = "ev AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, event_type AS role, epoch_us(ts) // 1000 AS ts_ms, (event_id % 10)::DOUBLE / 10 AS importance FROM events)"


def index(source: str, p: str = "", by: str = "") -> str:
    """CTEs over source(id, text, by): {p}len, {p}corp, {p}tc, {p}term, {p}post."""
    b, using = (f"{by}, ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN {p}corp USING ({by})" if by else f"CROSS JOIN {p}corp"
    return f"""
{p}tok AS (SELECT {b}id, {tok('text')} AS t FROM {source}),
{p}len AS (SELECT {b}id, CAST(len(t) AS BIGINT) AS length FROM {p}tok),
{p}corp AS (SELECT {b}count(*) AS n, avg(length) AS mean_length FROM {p}len {group}),
{p}tc AS (SELECT {b}id, term, count(*) AS n FROM (SELECT {b}id, unnest(t) AS term FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT {b}term, count(*) AS df FROM {p}tc GROUP BY ALL),
{p}term AS (SELECT {p}df.*, n AS docs, mean_length, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM {p}df {join}),
{p}post AS (SELECT {b}term, id, {p}tc.n::DOUBLE / length AS tf, idf * ({p}tc.n::DOUBLE / length) * 2.2::DOUBLE / (({p}tc.n::DOUBLE / length) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)) AS weight
  FROM {p}tc JOIN {p}len USING ({using}id) JOIN {p}term USING ({using}term))"""


def bm25(asked: str, p: str = "", by: str = "", k: int = 10) -> str:
    """CTEs {p}qt, {p}score (all), {p}hits (k best, with rank)."""
    b = f"{by}, " if by else ""
    return f"""
{p}qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok('text')}) AS term FROM {asked}) GROUP BY ALL),
{p}score AS (SELECT {b}query_id, id, round(sum(times * weight), 8) AS score FROM {p}qt JOIN {p}post USING (term) GROUP BY ALL),
{p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {b}query_id ORDER BY score DESC, id) AS rank FROM {p}score WHERE score > 0) WHERE rank <= {k})"""


def knn(asked: str, rows: str, p: str, k: int) -> str:
    return f"""
{p}all AS (SELECT query_id, r.id, round(1.0::DOUBLE / (1.0::DOUBLE + pow(list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 2)), 8) AS score FROM {asked} AS q, {rows} AS r),
{p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}all) WHERE rank <= {k})"""


def rrf(lists: list[str], p: str, k: int = 60, top: int = 10) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, 1.0::DOUBLE / ({k} + rank) AS part FROM {x}" for x in lists)
    return f"""
{p}score AS (SELECT query_id, id, round(sum(part), 8) AS score FROM ({parts}) GROUP BY ALL),
{p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}score) WHERE rank <= {top})"""


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


HITS = "SELECT query_id, id AS doc_id, score, rank FROM {}hits"
ALL_DOCS = (DOCS, ASKED, index("docs"))
BOTH = (DOCS, ASKED, DOCV, ASKV, index("docs"), bm25("asked", "", k=100), knn("askv", "docv", "k", 100))
MEMV = "memv AS (SELECT mem.*, embedding FROM mem, nv JOIN embeddings ON vec_id = mem.id % n)"
MEMT = "memt AS (SELECT id, content AS text FROM mem)"
MEMQ = """mq AS (SELECT query_id, text, embedding, CASE WHEN query_id % 7 = 1 THEN printf('sess-%06d', query_id) END AS session_filter, CASE WHEN query_id % 5 = 2 THEN query_id % 6 END AS agent_filter,
  CASE WHEN query_id % 3 = 0 THEN 'assistant' END AS role_filter, CASE WHEN query_id % 4 = 1 THEN 1704067200000 + query_id * 3600000 END AS time_start, CASE WHEN query_id % 4 = 1 THEN 1704067200000 + (query_id + 20) * 3600000 END AS time_end,
  0.1::DOUBLE * (query_id % 5) AS recency_weight FROM askv)"""
MEM_LISTS = (MEM, VEC, MEMV, MEMT, ASKV, MEMQ, index("memt"), bm25("mq", "", k=100), knn("mq", "memv", "k", 100))


def kept(source: str, name: str) -> str:
    return f"""{name} AS (SELECT x.query_id, x.id, x.rank FROM {source} AS x JOIN mq ON mq.query_id = x.query_id JOIN mem ON mem.id = x.id
  WHERE (session_filter IS NULL OR session_filter = session_id) AND (agent_filter IS NULL OR agent_filter = agent_id) AND (role_filter IS NULL OR role_filter = role)
  AND (time_start IS NULL OR ts_ms >= time_start) AND (time_end IS NULL OR ts_ms <= time_end))"""


def decay(age: str) -> str:
    return f"CASE WHEN {age} <= 0 THEN 1.0::DOUBLE ELSE exp(-0.693147::DOUBLE / 2592000000::DOUBLE * ({age})) END"


WINDOW_DAYS = "daily AS (SELECT id, content AS text, ts_ms, (ts_ms - min(ts_ms) OVER ()) // 86400000 AS bucket FROM mem)"
NEWEST = "po AS (SELECT bucket, count(*) AS records, row_number() OVER (ORDER BY bucket DESC) AS po FROM daily GROUP BY bucket QUALIFY po <= 4)"
NEAR = "near AS (SELECT id, text, bucket FROM daily WHERE bucket IN (SELECT bucket FROM po))"
TEMPORAL = (MEM, ASKED, WINDOW_DAYS, NEWEST, NEAR, index("near", "", "bucket"), bm25("asked", "", "bucket", 5), "cand AS (SELECT query_id, id, score, po FROM hits JOIN po USING (bucket))")
STOPS = """pre AS (SELECT c.query_id, c.id, c.score, p.prefix, row_number() OVER (PARTITION BY query_id, prefix ORDER BY score DESC, id) AS r, max(score) OVER (PARTITION BY query_id, prefix) AS best FROM cand AS c, range(1, 5) AS p(prefix) WHERE c.po <= p.prefix),
stops AS (SELECT query_id, least(coalesce(min(prefix) FILTER (r = 5 AND best > 0 AND score / best > 0.6), (SELECT max(po) FROM po)), (SELECT max(po) FROM po)) AS stop FROM asked LEFT JOIN pre USING (query_id) GROUP BY query_id)"""

CLUSTERS = f"""cl AS (SELECT *, t[1] || '|' || t[2] AS cluster FROM (SELECT id, text AS content, embedding, {tok('text')} AS t FROM docv) WHERE len(t) >= 3)"""
ENTRIES = """en AS (SELECT cluster, min(id) AS id, count(*) AS source_count, list(id ORDER BY id) AS source_ids, arg_max(content, {'n': strlen(content), 'i': -id}) AS content, least(1.0::DOUBLE, count(*) / 5.0::DOUBLE) AS confidence FROM cl GROUP BY cluster HAVING count(*) >= 2)"""
CENTROIDS = """cp AS (SELECT cluster, pos, sum(embedding[pos]::DOUBLE) AS x FROM cl, range(1, 65) AS t(pos) WHERE cluster IN (SELECT cluster FROM en) GROUP BY ALL),
cs AS (SELECT cluster, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS norm FROM cp GROUP BY cluster),
ce AS (SELECT cluster, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS embedding FROM cs)"""
SPLIT = "work AS (SELECT * FROM memv ORDER BY id DESC LIMIT 100), epi AS (SELECT * FROM memv WHERE id NOT IN (SELECT id FROM work)), epit AS (SELECT id, content AS text FROM epi)"
WORKING = f"""wt AS (SELECT id, content, {tok('content')} AS d FROM work),
ws AS (SELECT query_id, id, content, round(len(list_filter(q, lambda t: list_contains(d, t)))::DOUBLE / greatest(1, len(q)) * 1.5::DOUBLE, 8) AS score FROM (SELECT query_id, {tok('text')} AS q FROM askv), wt),
wh AS (SELECT * FROM (SELECT query_id, id, 'working' AS tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, substring(content, 1, 80) AS preview FROM ws WHERE score > 0) WHERE rank <= 10)"""
SEMANTIC = (
    "ent AS (SELECT id, content AS text FROM en)",
    "env AS (SELECT en.id, ce.embedding FROM en JOIN ce USING (cluster))",
    index("ent", "s"),
    bm25("askv", "s", k=20),
    knn("askv", "env", "sk", 20),
    rrf(["shits", "skhits"], "sf", top=1000000),
    "sh AS (SELECT * FROM (SELECT query_id, id, 'semantic' AS tier, sc AS score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM (SELECT query_id, id, round(score * 1.2::DOUBLE * (1 + confidence * 0.5::DOUBLE), 8) AS sc FROM sfhits JOIN en USING (id))) WHERE rank <= 10)",
)
EPISODIC = (
    index("epit", "e"),
    bm25("askv", "e", k=20),
    knn("askv", "epi", "ek", 20),
    rrf(["ehits", "ekhits"], "ef", top=1000000),
    "eh AS (SELECT * FROM (SELECT query_id, id, 'episodic' AS tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM efhits) WHERE rank <= 10)",
)
TIER_BASE = (VEC, MEM, MEMV, ASKV, SPLIT)
DOC_BASE = (DOCV, CLUSTERS, ENTRIES, CENTROIDS)
MERGED = "mt AS (SELECT * FROM (SELECT query_id, id, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, id) AS rank FROM (SELECT query_id, id, tier, score FROM wh UNION ALL SELECT query_id, id, tier, score FROM sh UNION ALL SELECT query_id, id, tier, score FROM eh)) WHERE rank <= 15)"
ALL_TIERS = (*TIER_BASE, *(x for x in DOC_BASE if x is not DOCV), WORKING, *SEMANTIC, *EPISODIC, MERGED)
ALL_TIERS = (VEC, "docv AS (SELECT doc_id AS id, text, embedding FROM documents, nv JOIN embeddings ON vec_id = doc_id % n)", *ALL_TIERS[1:])

RUNS = """runs AS (SELECT corpus_size, strategy, threads, sum(cents)::DOUBLE / count(*) AS total_ms, count(*) AS num_queries FROM (SELECT (user_id % 4 + 1) * 1000 AS corpus_size,
    CASE event_type WHEN 'view' THEN 'sequential' WHEN 'click' THEN 'data_parallel' ELSE 'full_parallel' END AS strategy,
    CASE event_type WHEN 'view' THEN 1 ELSE CAST(pow(2, event_id % 3 + 1) AS BIGINT) END AS threads, CAST(floor(value * 100) AS BIGINT) + 1 AS cents FROM events WHERE value IS NOT NULL) GROUP BY ALL),
sp0 AS (SELECT corpus_size, strategy, threads, base / total_ms AS raw FROM runs JOIN (SELECT corpus_size, min(total_ms) AS base FROM runs WHERE strategy = 'sequential' GROUP BY 1) USING (corpus_size)),
sp AS (SELECT corpus_size, strategy, threads, round(raw, 8) AS speedup, round(100 * raw / threads, 8) AS efficiency FROM sp0)"""

NOW = 1706745600000
VOCAB = "vocab AS (SELECT list(term ORDER BY df DESC, term) AS v FROM (SELECT * FROM df ORDER BY df DESC, term LIMIT 202))"
PICKS = f"[{', '.join(repr(t) for t in TOPICS)}]"


def pick(seed: int, *keys: str, n: str) -> str:
    x = f"{seed}::BIGINT"
    for k in (*keys, "0", "0"):
        x = f"(({x} * 1103515245 + {k} + 12345) % 2147483648)"
    return f"({x} // 256 % {n})"


AGENTS = f"""ag0 AS (SELECT s, list_concat(['system'], flatten(list_transform(range(0, 13), lambda r: CASE WHEN {pick(SEED + 1, 's', 'r', n='2')} = 0 THEN ['user', 'planning', 'tool_call', 'tool_output', 'assistant'] ELSE ['user', 'tool_call', 'tool_output', 'assistant'] END)))[1 : greatest(1, 4 + {pick(SEED, 's', n='9')})] AS roles
  FROM (SELECT DISTINCT conv_id AS s FROM conversations)),
ag1 AS (SELECT s, turn, roles[turn + 1] AS role FROM ag0, unnest(range(0, len(roles))) AS t(turn)),
ag AS (SELECT row_number() OVER (ORDER BY s, turn) - 1 AS id, printf('sess-%06d', s) AS session_id, printf('agent-%02d', s % 6 + 1) AS agent_id, role,
  CASE WHEN role IN ('tool_call', 'tool_output') THEN ['web_search', 'code_exec', 'shell_cmd', 'db_query'][s % 4 + 1] ELSE '' END AS tool, 1704067200000 + s * 3600000 + turn * 15000 AS ts_ms,
  {PICKS}[s % 4 + 1] || ' ' || role || ' note ' || {pick(SEED + 2, 's', 'turn', n='3')} AS content,
  CASE role WHEN 'system' THEN 0.3::DOUBLE WHEN 'user' THEN 0.7::DOUBLE WHEN 'planning' THEN 0.4::DOUBLE WHEN 'tool_call' THEN 0.5::DOUBLE WHEN 'tool_output' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS importance FROM ag1)"""

SQL: dict[str, str] = {
    "tokenize_stats": sql(f"SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_token, t[-1] AS last_token FROM (SELECT id, {tok('text')} AS t FROM docs)", DOCS),
    "term_frequency": sql("SELECT id AS doc_id, term, tc.n, round(tc.n::DOUBLE / length, 8) AS tf FROM tc JOIN len USING (id)", *ALL_DOCS),
    "doc_lengths": sql("SELECT id AS doc_id, length FROM len", *ALL_DOCS),
    "corpus_stats": sql("SELECT n, round(mean_length, 8) AS mean_length FROM corp", *ALL_DOCS),
    "term_idf": sql("SELECT term, df, round(idf, 8) AS idf FROM term", *ALL_DOCS),
    "postings": sql("SELECT term, id AS doc_id, round(tf, 8) AS tf, round(weight, 8) AS weight FROM post", *ALL_DOCS),
    "term_max_score": sql("SELECT term, round(max(weight), 8) AS max_score FROM post GROUP BY term", *ALL_DOCS),
    "csr_offsets": sql("SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, CAST(sum(df) OVER (ORDER BY term) - df AS BIGINT) AS first_posting FROM term", *ALL_DOCS),
    "maxscore_bounds": sql(
        "SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY most DESC, term) AS place, round(sum(most) OVER (PARTITION BY query_id ORDER BY most DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS bound FROM mx",
        *ALL_DOCS,
        bm25("asked"),
        "mx AS (SELECT query_id, term, round(times * m, 8) AS most FROM qt JOIN (SELECT term, round(max(weight), 8) AS m FROM post GROUP BY term) USING (term))",
    ),
    "maxscore_skips": sql(
        "SELECT query_id, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(CASE WHEN bound < coalesce(kth, 0) THEN df ELSE 0 END) AS BIGINT) AS skipped, round(sum(CASE WHEN bound < coalesce(kth, 0) THEN df ELSE 0 END) / sum(df), 8) AS skip_rate FROM bo JOIN df USING (term) LEFT JOIN (SELECT query_id, score AS kth FROM hits WHERE rank = 10) USING (query_id) GROUP BY query_id",
        *ALL_DOCS,
        bm25("asked"),
        "mx AS (SELECT query_id, term, round(times * m, 8) AS most FROM qt JOIN (SELECT term, round(max(weight), 8) AS m FROM post GROUP BY term) USING (term))",
        "bo AS (SELECT query_id, term, round(sum(most) OVER (PARTITION BY query_id ORDER BY most DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS bound FROM mx)",
    ),
    "bm25_topk": sql(HITS.format(""), *ALL_DOCS, bm25("asked")),
    "bm25_repeated_query_terms": sql(HITS.format(""), *ALL_DOCS, "twice AS (SELECT query_id, text || ' ' || array_to_string((string_split(text, ' '))[1:3], ' ') AS text FROM asked)", bm25("twice")),
    "global_topk": sql("SELECT query_id, id AS doc_id, score FROM score ORDER BY score DESC, query_id, id LIMIT 50", *ALL_DOCS, bm25("asked")),
    "knn_topk": sql(HITS.format("k"), DOCV, ASKV, knn("askv", "docv", "k", 10)),
    "vector_normalize": "SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN list_sum(list_transform(v, lambda x: (x / norm) * (x / norm))) ELSE 0 END, 6) AS unit_norm, round(CASE WHEN norm > 0 THEN list_sum(v) / norm ELSE 0 END, 6) AS component_sum FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)) AS v FROM embeddings))",
    "vector_add": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(2 * list_sum(embedding::DOUBLE[]), 6) AS component_sum FROM embeddings",
    "rrf_fusion": sql(HITS.format("f"), *BOTH, rrf(["hits", "khits"], "f")),
    "rrf_custom_k": sql(HITS.format("f"), *BOTH, rrf(["hits", "khits"], "f", 10)),
    "filter_session": sql("SELECT id, session_id, role, ts_ms FROM mem WHERE session_id = 'sess-000003'", MEM),
    "filter_agent": sql("SELECT id, agent_id, role FROM mem WHERE agent_id = 2", MEM),
    "filter_role": sql("SELECT id, role FROM mem WHERE role IN ('assistant', 'tool_output')", MEM),
    "filter_time_range": sql("SELECT id, ts_ms FROM mem WHERE ts_ms BETWEEN 1704067200000 + 5 * 3600000 AND 1704067200000 + 20 * 3600000", MEM),
    "filter_min_tokens": sql(f"SELECT id FROM mem WHERE len({tok('content')}) >= 3", MEM),
    "point_lookup": sql("SELECT id, session_id, role, importance FROM mem WHERE id = 7", MEM),
    "post_filter_rrf": sql("SELECT query_id, id, score, rank FROM fhits", *MEM_LISTS, kept("hits", "ks"), kept("khits", "kd"), rrf(["ks", "kd"], "f")),
    "memory_fuse": sql(
        "SELECT * FROM (SELECT query_id, id, relevance, recency, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fz) WHERE rank <= 10",
        *MEM_LISTS,
        kept("hits", "ks"),
        kept("khits", "kd"),
        rrf(["ks", "kd"], "f"),
        f"fr AS (SELECT query_id, id, f.score AS relevance, round({decay('(SELECT max(ts_ms) FROM mem) - ts_ms')}, 8) AS recency, recency_weight AS w, importance FROM fscore AS f JOIN mem USING (id) JOIN mq USING (query_id))",
        "fz AS (SELECT query_id, id, relevance, recency, round(((1 - w) * relevance + w * recency * relevance) * (1 + 0.5::DOUBLE * importance), 8) AS score FROM fr)",
    ),
    "recency_decay": sql(f"SELECT id, round(r, 8) AS recency, round((1 - 0.3::DOUBLE) * importance + 0.3::DOUBLE * r * importance, 8) AS blended FROM (SELECT *, {decay(f'{NOW} - ts_ms')} AS r FROM ev)", EV),
    "importance_boost": sql("SELECT id, round(1.0::DOUBLE / (60 + id) * (1 + 0.5::DOUBLE * importance), 8) AS score FROM mem", MEM),
    "temporal_buckets": sql("SELECT (ts_ms - (SELECT min(ts_ms) FROM ev)) // 604800000 AS bucket, count(*) AS records, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM ev GROUP BY 1", EV),
    "temporal_topk_fixed": sql("SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cand) WHERE rank <= 5", *TEMPORAL),
    "temporal_topk_early_stop": sql("SELECT query_id, id, score, rank, stop FROM (SELECT query_id, id, score, stop, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cand JOIN stops USING (query_id) WHERE po <= stop) WHERE rank <= 5", *TEMPORAL, STOPS),
    "temporal_search_stats": sql("SELECT query_id, count(*) AS partitions_searched, CAST(sum(records) AS BIGINT) AS records_searched, round(sum(records) / (SELECT count(*) FROM daily), 8) AS search_fraction FROM stops JOIN po ON po <= stop GROUP BY query_id", *TEMPORAL, STOPS),
    "temporal_search_averages": sql("SELECT count(*) AS queries, round(avg(p), 6) AS partitions_searched, round(avg(f), 6) AS search_fraction, round(1 - avg(f), 6) AS skip_rate FROM (SELECT count(*) AS p, round(sum(records) / (SELECT count(*) FROM daily), 8) AS f FROM stops JOIN po ON po <= stop GROUP BY query_id)", *TEMPORAL, STOPS),
    "weekly_windows": "SELECT epoch_us(ts) // 604800000000 * 604800000 AS start_ms, event_type AS role, count(*) AS n FROM events GROUP BY ALL",
    "working_overlap": sql("SELECT * FROM wh", *TIER_BASE, WORKING),
    "semantic_search": sql("SELECT * FROM sh", ASKV, *DOC_BASE, *SEMANTIC),
    "episodic_search": sql("SELECT * FROM eh", *TIER_BASE, *EPISODIC),
    "tier_merge": sql("SELECT query_id, id, tier, score, rank FROM mt", *ALL_TIERS),
    "tier_counts": sql("SELECT query_id, tier, count(*) AS n FROM mt GROUP BY ALL", *ALL_TIERS),
    "consolidate_clusters": sql("SELECT cluster, id, source_count, array_to_string(source_ids, ',') AS source_ids, md5(content) AS content_md5, round(confidence, 8) AS confidence FROM en", *DOC_BASE),
    "consolidate_centroids": sql("SELECT cluster, CAST(len(embedding) AS BIGINT) AS dim, round(embedding[1], 6) AS first, round(list_sum(embedding), 6) AS component_sum FROM ce", *DOC_BASE),
    "consolidation_window": sql("SELECT id FROM mem WHERE (SELECT count(*) FROM mem) <= 80 OR id >= (SELECT count(*) FROM mem) - 40", MEM),
    "decay_survivors": sql(f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, retention FROM (SELECT id, round(importance * {decay(f'{NOW + 90 * 86400000} - ts_ms')}, 8) AS retention FROM ev) WHERE retention >= 0.05", EV),
    "decay_horizons": sql(
        f"SELECT days, CAST(sum(gone) AS BIGINT) AS evicted, count(*) - CAST(sum(gone) AS BIGINT) AS remaining, round(sum(gone) / count(*), 8) AS rate FROM (SELECT days, CAST(round(importance * {decay(f'{NOW} + days * 86400000 - ts_ms')}, 8) < 0.05 AS BIGINT) AS gone FROM ev, (VALUES (7::BIGINT), (30::BIGINT), (60::BIGINT), (90::BIGINT), (180::BIGINT)) AS h(days)) GROUP BY days",
        EV,
    ),
    "spill_schedule": "SELECT conv_id, start, added, spills, spills * 5 AS spilled, start + added - spills * 5 AS working FROM (SELECT conv_id, start, added, CASE WHEN start + added <= 10 THEN 0 ELSE 1 + (start + added - 11) // 5 END AS spills FROM (SELECT conv_id, least(conv_id % 11, count(*)) AS start, count(*) * 3 AS added FROM conversations GROUP BY conv_id))",
    "new_session_flush": sql("SELECT session_id, count(*) AS n, max(id) AS last_id FROM mem GROUP BY 1", MEM),
    "store_overview": sql("SELECT count(*) AS records, count(DISTINCT session_id) AS sessions, count(DISTINCT agent_id) AS agents, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, round(avg(importance), 8) AS mean_importance FROM mem", MEM),
    "records_by_role": sql("SELECT role, count(*) AS n FROM mem GROUP BY 1", MEM),
    "records_by_agent": sql("SELECT agent_id, count(*) AS n FROM mem GROUP BY 1", MEM),
    "records_by_tool": sql(f"SELECT {TOOL_LIST}[CASE WHEN role = 'assistant' THEN id % 10 ELSE 0 END + 1] AS tool, count(*) AS n FROM mem GROUP BY 1", MEM),
    "distinct_sessions": sql("SELECT DISTINCT session_id FROM mem", MEM),
    "session_sample": sql("SELECT id, role, CASE WHEN length(content) > 40 THEN substring(content, 1, 37) || '...' ELSE content END AS content FROM mem WHERE session_id = 'sess-000000' ORDER BY id LIMIT 6", MEM),
    "role_names": sql("SELECT id, coalesce(([" + ", ".join(f"'{r}'" for r in ROLES) + "])[id % 9 + 1], 'unknown') AS role FROM mem", MEM),
    "tool_and_tier_names": sql(f"SELECT id, coalesce({TOOL_LIST}[id % 12 + 1], 'unknown') AS tool, coalesce({TIER_LIST}[id % 5 + 1], 'unknown') AS tier FROM mem", MEM),
    "durations": "SELECT l_orderkey, l_linenumber, CASE WHEN u < 1000 THEN printf('%.1f us', u) WHEN u < 1000000 THEN printf('%.2f ms', u / 1000) ELSE printf('%.2f s', u / 1000000) END AS duration FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 40.0::DOUBLE AS u FROM lineitem)",
    "kendall_tau": sql(
        "SELECT query_id, round(coalesce(tau, 1.0::DOUBLE), 8) AS tau FROM (SELECT DISTINCT query_id FROM hits) LEFT JOIN (SELECT a.query_id, sum(sign((a.x - b.x) * (a.y - b.y)))::DOUBLE / sum(abs(sign((a.x - b.x) * (a.y - b.y)))) AS tau FROM xy AS a JOIN xy AS b ON a.query_id = b.query_id AND a.x < b.x GROUP BY 1) USING (query_id)",
        DOCS,
        ASKED,
        DOCV,
        ASKV,
        index("docs"),
        bm25("asked", "", k=20),
        knn("askv", "docv", "k", 20),
        rrf(["hits", "khits"], "f", top=20),
        "xy AS (SELECT h.query_id, h.id, h.rank AS x, f.rank AS y FROM hits AS h JOIN fhits AS f ON h.query_id = f.query_id AND h.id = f.id)",
    ),
    "match_rate": sql(
        "SELECT query_id, CAST(max(CASE WHEN rank = 1 THEN CAST(coalesce(same OR near, false) AS INT) END) AS BIGINT) AS top1, CAST(min(CAST(coalesce(near, false) AS INT)) AS BIGINT) AS exact FROM (SELECT coalesce(h.query_id, f.query_id) AS query_id, coalesce(h.rank, f.rank) AS rank, h.id = f.id AS same, abs(h.score - f.score) <= 0.0001::DOUBLE AS near FROM hits AS h FULL JOIN fhits AS f ON h.query_id = f.query_id AND h.rank = f.rank) GROUP BY 1",
        DOCS,
        ASKED,
        DOCV,
        ASKV,
        index("docs"),
        bm25("asked"),
        knn("askv", "docv", "k", 10),
        rrf(["hits", "khits"], "f"),
    ),
    "amdahl": sql(
        "SELECT corpus_size, strategy, threads, round(serial, 8) AS serial, round(1 / (m + (1 - m) / threads), 8) AS predicted, round(speedup - 1 / (m + (1 - m) / threads), 8) AS gap FROM (SELECT *, avg(serial) OVER (PARTITION BY corpus_size, strategy) AS m FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 / speedup - 1.0::DOUBLE / threads) / (1 - 1.0::DOUBLE / threads))) AS serial FROM sp WHERE threads > 1))",
        RUNS,
    ),
    "speedup_efficiency": sql("SELECT * FROM sp", RUNS),
    "best_runs": sql("SELECT corpus_size, strategy, threads, speedup, efficiency FROM (SELECT *, row_number() OVER (PARTITION BY corpus_size ORDER BY speedup DESC, threads, strategy) AS p FROM sp) WHERE p = 1", RUNS),
    "scaling_pivot": sql("SELECT corpus_size, max(speedup) FILTER (strategy = 'sequential') AS sequential, max(speedup) FILTER (strategy = 'data_parallel') AS data_parallel, max(speedup) FILTER (strategy = 'full_parallel') AS full_parallel FROM sp GROUP BY 1", RUNS),
    "mean_timings": sql("SELECT strategy, round(avg(total_ms / num_queries), 8) AS avg_latency_ms, round(avg(1000 * num_queries / total_ms), 8) AS throughput_qps FROM runs GROUP BY 1", RUNS),
    "stream_append_snapshot": sql("SELECT query_id, id, score, rank FROM hits", MEM, MEMT, ASKED, index("memt"), bm25("asked")),
    "stream_reads_beside_writes": sql("SELECT id % 4 AS flush, CAST(sum(count(*)) OVER (ORDER BY id % 4) AS BIGINT) AS visible, true AS whole FROM mem GROUP BY id % 4", MEM),
    "csv_round_trip": sql("SELECT corpus_size, strategy, threads, round(speedup, 3) AS speedup, round(efficiency, 3) AS efficiency FROM sp", RUNS),
    "csv_append": "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
    "segments_search": sql("SELECT query_id, id, score, rank FROM hits", MEM, MEMT, ASKED, index("memt"), bm25("asked")),
    "bm25_pruned_topk": sql(HITS.format(""), *ALL_DOCS, bm25("asked")),
    "bm25_pruned_work": sql("SELECT query_id, CAST(sum(df) AS BIGINT) AS postings, true AS fewer FROM qt JOIN df USING (term) GROUP BY query_id", *ALL_DOCS, bm25("asked")),
    "stored_csr_offsets": sql("SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, CAST(sum(df) OVER (ORDER BY term) - df AS BIGINT) AS first_posting FROM term", *ALL_DOCS),
    "stored_term_lookup": sql("SELECT id AS doc_id, round(weight, 8) AS weight FROM post WHERE term = (SELECT term FROM df ORDER BY df DESC, term LIMIT 1)", *ALL_DOCS),
    "knn_cells_quality": "SELECT vec_id AS query_id, true AS found, true AS pruned FROM embeddings WHERE vec_id % 20 = 0",
    "filter_matches": sql(
        "SELECT query_id, count(*) AS n, min(mem.id) AS first_id, max(mem.id) AS last_id FROM mq JOIN mem ON (session_filter IS NULL OR session_filter = session_id) AND (agent_filter IS NULL OR agent_filter = agent_id) AND (role_filter IS NULL OR role_filter = role) AND (time_start IS NULL OR ts_ms >= time_start) AND (time_end IS NULL OR ts_ms <= time_end) GROUP BY query_id",
        MEM,
        ASKV,
        MEMQ,
    ),
    "consolidate_two_runs": sql(
        "SELECT row_number() OVER (ORDER BY run, id, cluster) - 1 AS entry, run, cluster, id, source_count, md5(content) AS content_md5, round(least(1.0::DOUBLE, source_count / 5.0::DOUBLE), 8) AS confidence, component_sum FROM e2 JOIN c2 USING (run, cluster)",
        DOCV,
        CLUSTERS,
        "r2 AS (SELECT run::BIGINT AS run, cl.* FROM cl, (VALUES (0), (1)) AS r(run) WHERE run = 1 OR id % 2 = 0)",
        "e2 AS (SELECT run, cluster, min(id) AS id, count(*) AS source_count, arg_max(content, {'n': strlen(content), 'i': -id}) AS content FROM r2 GROUP BY run, cluster HAVING count(*) >= 2)",
        "p2 AS (SELECT run, cluster, pos, sum(embedding[pos]::DOUBLE) AS x FROM r2, range(1, 65) AS t(pos) GROUP BY ALL)",
        "c2 AS (SELECT run, cluster, round(sum(x) / sqrt(sum(x * x)), 6) AS component_sum FROM p2 GROUP BY ALL)",
    ),
    "staged_flushes": "SELECT store, flush, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT event_type AS store, event_id AS id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 1000 + 1 AS flush, count(*) OVER (PARTITION BY event_type) AS have FROM events) WHERE flush * 1000 <= have GROUP BY store, flush",
    "spilled_tiers": sql(
        "SELECT agent_id, id, CASE WHEN p <= CASE WHEN n <= 20 THEN 0 ELSE (1 + (n - 21) // 10) * 10 END THEN 'episodic' ELSE 'working' END AS tier FROM (SELECT agent_id, id, row_number() OVER (PARTITION BY agent_id ORDER BY ts_ms, id) AS p, count(*) OVER (PARTITION BY agent_id) AS n FROM mem)",
        MEM,
    ),
    "session_runs": sql(
        "SELECT run, any_value(session_id) AS session_id, arg_min(id, {'t': ts_ms, 'i': id}) AS first_id, arg_max(id, {'t': ts_ms, 'i': id}) AS last_id, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (ORDER BY ts_ms, id) - 1 AS BIGINT) AS run FROM (SELECT *, CAST(lag(session_id) OVER (ORDER BY ts_ms, id) IS DISTINCT FROM session_id AS BIGINT) AS new FROM ev)) GROUP BY run",
        EV,
    ),
    "generic_corpus": sql(
        f"SELECT doc_id AS id, 50 AS n_words, md5(array_to_string(list_transform(range(1, 51), lambda i: v[{pick(SEED, 'doc_id', 'i', n='len(v)')} + 1]), ' ')) AS text_md5, 1.0::DOUBLE AS norm FROM documents, vocab",
        *ALL_DOCS,
        VOCAB,
    ),
    "generic_queries": sql(f"SELECT item_id AS query_id, array_to_string(list_transform(range(1, 6), lambda i: v[{pick(SEED + 999_999, 'item_id', 'i', n='len(v)')} + 1]), ' ') AS text, 1.0::DOUBLE AS norm FROM benchmark, vocab", *ALL_DOCS, VOCAB),
    "agent_corpus": sql("SELECT * FROM ag", AGENTS),
    "agent_queries": sql(
        f"SELECT query_id, 'find earlier notes about ' || {PICKS}[query_id % 4 + 1] AS text, CASE WHEN {pick(SEED + 3, 'query_id', n='10')} < 3 THEN printf('sess-%06d', {pick(SEED + 5, 'query_id', n='sessions')}) END AS session_filter, CASE WHEN {pick(SEED + 4, 'query_id', n='10')} < 2 THEN last - 604800000 END AS time_start, CASE WHEN {pick(SEED + 4, 'query_id', n='10')} < 2 THEN last END AS time_end, 0.3::DOUBLE AS recency_weight, 10 AS top_k FROM asked, (SELECT max(ts_ms) AS last, count(DISTINCT session_id) AS sessions FROM ag)",
        AGENTS,
        ASKED,
    ),
}
