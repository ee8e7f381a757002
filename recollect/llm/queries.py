"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query reads whole tables, calls its operator and derives the result columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm import best_fit, byte_bpe, chat_format, decontaminate, jaccard_join, language, merkle, mpegts, prefix_trie, suffix_dedup, token_counts, toxicity, window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    """Where the installed rank file of the production tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(_table(spark, sf_dir, "documents"), rank_file(), outputs=["n_tokens", "ids_sha256", "decoded_sha256"])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS h FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(g.g, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(u) AS g FROM r GROUP BY v) AS g ON g.v = d.doc_id
"""


def remainder(column: str, modulus: int):
    """crc32 of a value as text, modulo a number: the folds of the learned operators.  Null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.FactorizationMachine:
    """Fitted without the held-out fold."""
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return toxicity.train(_table(spark, sf_dir, "documents"), labels)


TOXIC_FROM = 0.3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id have no label and are not learned from: they count as held out."""
    scores = toxicity.scored(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scores.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", decontaminate.hit_words(F.col("removed")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


# as the operator: rows without an id are compared with themselves alone, rows of one id not with each other
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT i, doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM d, unnest(range(1, greatest(0, len(w) - 19) + 1)) AS t(p)),
r AS (SELECT i, p, row_number() OVER (PARTITION BY s, i ORDER BY p) AS n, coalesce(doc_id > min(doc_id) OVER (PARTITION BY s), false) AS later FROM v),
g AS (SELECT DISTINCT i, q FROM r, unnest(range(p, p + 20)) AS t(q) WHERE n > 1 OR later),
a AS (SELECT i, q, w[q] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
k AS (SELECT a.i, count(g.q) AS n_removed, string_agg(x, ' ' ORDER BY a.q) FILTER (g.q IS NULL) AS kept FROM a LEFT JOIN g ON a.i = g.i AND a.q = g.q GROUP BY a.i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (i)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), keep="none")
    return kept.select("doc_id", "n_bytes", decontaminate.hit_words(F.col("removed")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# as the operator: rows that repeat whole are one document, rows without an id are compared with nothing
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(text)) AS h FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)),
v AS (SELECT i, unnest(range(0, greatest(0, length(h) // 2 - 399))) AS p, unnest(list_transform(range(0, greatest(0, length(h) // 2 - 399)), lambda p: hash(substr(h, 2 * p + 1, 800)))) AS x FROM d),
g AS (SELECT i, p FROM v WHERE x IN (SELECT x FROM v GROUP BY x HAVING count(*) > 1)),
e AS (SELECT i, p, CAST(coalesce(p > lag(p) OVER (PARTITION BY i ORDER BY p) + 400, true) AS BIGINT) AS new FROM g),
j AS (SELECT i, min(p) AS lo, max(p) + 400 AS hi FROM (SELECT i, p, sum(new) OVER (PARTITION BY i ORDER BY p) AS n FROM e) GROUP BY i, n),
k AS (SELECT i, lo, hi, coalesce(lag(hi) OVER (PARTITION BY i ORDER BY lo), 0) AS before FROM j),
s AS (SELECT doc_id, h, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM k JOIN d USING (i) GROUP BY i, doc_id, h),
o AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT o.doc_id, CAST(length(o.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(o.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM o LEFT JOIN s ON o.doc_id = s.doc_id AND o.h = s.h
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id belong to no fold: they are not learned from and count as held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    model = language.train(docs.where(~held_out))
    return language.identified(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.preference_pairs(chat_format.neighbours(_table(spark, sf_dir, "conversations")))
    mask = lambda side: F.array_join(F.transform(f"{side}_mask", lambda s: F.concat_ws("-", s.cast("array<string>"))), ",").alias(f"{side}_mask")
    return pairs.select("pair", "chosen_id", "rejected_id", "n_common", "prompt", "chosen_completion", mask("chosen"), "rejected_completion", mask("rejected"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
u AS (SELECT conv_id // 2 AS pair, conv_id % 2 = 0 AS chosen, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, x,
      '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10) AS shown FROM t),
c AS (SELECT * FROM u WHERE chosen), r AS (SELECT * FROM u WHERE NOT chosen),
m AS (SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.n, r.n) AS n, coalesce(c.x = r.x, false) AS same, c.shown FROM c FULL JOIN r ON c.pair = r.pair AND c.n = r.n),
p AS (SELECT pair, coalesce(min(n) FILTER (NOT same), count(*) + 1) AS differ FROM m GROUP BY pair),
o AS (SELECT pair, coalesce(string_agg(shown, '' ORDER BY n) FILTER (n < differ), '') AS prompt, any_value(differ) - 1 AS n_common FROM m JOIN p USING (pair) GROUP BY pair),
q AS (SELECT u.*, n >= differ AS rest, coalesce(sum(length(shown)) FILTER (n >= differ) OVER (PARTITION BY conv_id ORDER BY n), 0) AS after FROM u JOIN p USING (pair)),
s AS (SELECT pair, chosen, any_value(conv_id) AS id, coalesce(string_agg(shown, '' ORDER BY n) FILTER (rest), '') AS completion,
      coalesce(string_agg((after - length(x.text) - 11)::BIGINT || '-' || after::BIGINT, ',' ORDER BY n) FILTER (rest AND x.role = 'assistant'), '') AS mask FROM q GROUP BY pair, chosen)
SELECT o.pair, a.id AS chosen_id, b.id AS rejected_id, CAST(o.n_common AS BIGINT) AS n_common, o.prompt,
       a.completion AS chosen_completion, a.mask AS chosen_mask, b.completion AS rejected_completion, b.mask AS rejected_mask
FROM o LEFT JOIN s AS a ON a.pair = o.pair AND a.chosen LEFT JOIN s AS b ON b.pair = o.pair AND NOT b.chosen
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn("contaminated", decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")))


def op9_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), mpegts.padded(F.col("text")).alias("payload"))
    media = mpegts.stored(rows, "payload", carry=["doc_id", "n_bytes"])
    back = mpegts.parsed(media, carry=["doc_id", "n_bytes", "media"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), rank_file())


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT i, p, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM d, ks, unnest(range(1, greatest(0, len(w) - k + 1) + 1)) AS t(p)),
m AS (SELECT i, p, dw.k, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
h AS (SELECT i, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT i, p, k FROM m) AS x, unnest(range(p, p + k)) AS t(q) GROUP BY i),
n AS (SELECT i, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY i)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (i) LEFT JOIN n USING (i)
"""

def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id are never tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.coalesce(remainder("doc_id", 7) == 0, F.lit(False))
    claimed = [F.col("n_chars") + changed.cast("bigint") if c == "n_chars" else F.col(c) for c in fields]
    docs = _table(spark, sf_dir, "documents").withColumn("claimed", merkle.leaf_digest(*claimed))
    proofs = merkle.manifest(docs, merkle.leaf_digest(*map(F.col, fields)), carry=["doc_id", "claimed"])
    found = proofs.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", F.col("peak").alias("subroot"), "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def crc32_sql(text: str) -> str:
    """DuckDB's text for the CRC-32 of an ASCII text; null for null."""
    step = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: {step})), 4294967295) END"


OP11_SQL = f"""
WITH RECURSIVE c AS (SELECT *, n_chars + CASE WHEN ({crc32_sql('doc_id::VARCHAR')}) % 7 = 0 THEN 1 ELSE 0 END AS claimed_chars FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce('+' || lang, '') AS part, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "claimed_chars")} AS claimed FROM c),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY part) AS n FROM d),
t AS (SELECT 0 AS level, part, place, leaf AS h, n FROM r
      UNION ALL SELECT level + 1, part, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY level, part, place // 2),
p AS (SELECT part, h, row_number() OVER (ORDER BY encode(part)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, h, n FROM p UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, place // 2),
i AS (SELECT k, level, r.part, r.place >> level AS spot FROM r JOIN (SELECT DISTINCT part, level FROM t WHERE n > 1) USING (part)),
j AS (SELECT k, level + 1000 AS level, p.place >> level AS spot FROM r JOIN p USING (part), (SELECT DISTINCT level FROM u WHERE n > 1)),
s AS (SELECT k, i.level, CASE WHEN h IS NULL THEN '' WHEN spot % 2 = 1 THEN 'l' || h ELSE 'r' || h END AS step FROM i LEFT JOIN t ON t.part = i.part AND t.level = i.level AND t.place = xor(spot, 1)
      UNION ALL SELECT k, j.level, CASE WHEN h IS NULL THEN '' WHEN spot % 2 = 1 THEN 'l' || h ELSE 'r' || h END FROM j LEFT JOIN u ON u.level + 1000 = j.level AND u.place = xor(spot, 1)),
g AS (SELECT k, list(step ORDER BY level) AS steps, string_agg(step[2:], '' ORDER BY level) AS others FROM s GROUP BY k),
f AS (SELECT r.*, coalesce(others, '') AS others, list_reduce(list_concat([claimed], coalesce(steps, [])), lambda a, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || a WHEN x[1] = 'r' THEN a || x[2:] ELSE a END)) AS folded_root FROM r LEFT JOIN g USING (k))
SELECT doc_id, leaf, p.h AS subroot, o.h AS root, sha256(others) AS proof_sha256, folded_root, folded_root = o.h AS verified FROM f JOIN p USING (part), (SELECT h FROM u WHERE n = 1) AS o
"""

def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank file has the vocabulary of byte_bpe_50k.json, with the same ids."""
    import public_tokenizers

    return best_fit.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    rebuilt = prefix_trie.with_shared_heads(_table(spark, sf_dir, "conversations"), conv - conv % 5, remainder("conv_id", 9))
    return prefix_trie.trie_nodes(rebuilt)


OP13_SQL = f"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, sha256(strlen(x.r)::VARCHAR || ':' || x.r || x.t)) AS w, ({crc32_sql('any_value(conv_id)::VARCHAR')}) % 9 AS h FROM t GROUP BY conv_id),
b AS (SELECT l.conv_id AS c, list_concat(coalesce(a.w, [])[1:l.h], l.w[l.h + 1:]) AS w FROM l LEFT JOIN l AS a ON a.conv_id = l.conv_id - l.conv_id % 5),
p AS (SELECT c, d, w[1:d] AS k, d = len(w) AS ends, CASE WHEN d > 0 THEN strlen(w[d].t) ELSE 0 END AS size FROM b, unnest(range(0, len(w) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT d, k, min(c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM p GROUP BY d, k),
m AS MATERIALIZED (SELECT p.c AS member, p.d, n.c FROM p JOIN n ON n.d = p.d AND n.k = p.k),
f AS (SELECT n.*, m.c AS parent FROM n LEFT JOIN m ON m.member = n.c AND m.d = n.d - 1),
k AS (SELECT parent AS c, d - 1 AS d, count(*) AS children FROM f WHERE d > 0 GROUP BY ALL),
s AS (SELECT m.c, m.d, sum(CASE WHEN k.children IS NULL THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.size) AS saved
      FROM f LEFT JOIN k ON k.c = f.c AND k.d = f.d JOIN m ON m.member = f.c AND m.d <= f.d GROUP BY m.c, m.d)
SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, CAST(coalesce(k.children, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON s.c = f.c AND s.d = f.d LEFT JOIN k ON k.c = f.c AND k.d = f.d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_jaccard_join": op1_jaccard_join, "op2_byte_bpe": op2_byte_bpe, "op3_toxicity": op3_toxicity, "op4_window_dedup": op4_window_dedup, "op5_suffix_dedup": op5_suffix_dedup, "op6_language": op6_language, "op7_chat_format": op7_chat_format, "op8_decontaminate": op8_decontaminate, "op9_mpegts": op9_mpegts, "op10_token_counts": op10_token_counts, "op11_merkle": op11_merkle, "op12_best_fit": op12_best_fit, "op13_prefix_trie": op13_prefix_trie}
SQL: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op4_window_dedup": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op7_chat_format": OP7_SQL, "op8_decontaminate": OP8_SQL, "op11_merkle": OP11_SQL, "op13_prefix_trie": OP13_SQL}
