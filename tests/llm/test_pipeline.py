"""The pipeline against the operators' brute-force tests' properties, on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from recollect.llm import queries


def test_stages_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "decontaminate", "byte_bpe"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["predicted"] for r in queries.op3_toxicity(spark, sf).collect()}
    calm = stages["toxicity"](spark, docs, sf)
    assert calm.columns == docs.columns
    assert {r["doc_id"] for r in calm.collect()} == {i for i, p in scores.items() if not p}
    single = stages["jaccard_join"](spark, calm, sf)
    assert single.columns == docs.columns
    groups = queries.jaccard_join.similar_groups(calm).where("doc_id = component_id").select("doc_id")
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in groups.collect()}
    cut = stages["suffix_dedup"](spark, single, sf)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert len(r["text"]) <= len(before[r["doc_id"]])
        assert r["text"] != before[r["doc_id"]] or r["n_chars"] == docs.where(F.col("doc_id") == r["doc_id"]).first()["n_chars"]
    clean = stages["decontaminate"](spark, cut, sf)
    assert clean.columns == docs.columns
    assert set(clean.select("doc_id").collect()) <= set(cut.select("doc_id").collect())
    last = stages["byte_bpe"](spark, clean, sf)
    assert last.count() == clean.count()


def test_repeated_rows_leave_one(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, long, "en", "b", 5), (1, long, "en", "a", 6), (1, long, "en", "a", 6), (2, long, "en", "a", 5), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "alone", None, "a", 5), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = stages["jaccard_join"](spark, docs, sf)
    assert single.columns == docs.columns
    assert sorted(map(repr, map(tuple, single.collect()))) == sorted(map(repr, [rows[1], rows[4], *rows[6:]]))
    assert {r["text"] for r in stages["suffix_dedup"](spark, single, sf).where("doc_id = 1").collect()} == {long}


def test_run_with_odd_rows(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all", "en", "s", 12), (3, "same words " * 100, "en", "s", 1100), (4, "same words " * 100, "fr", "s", 1100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, 3} and got[1] == got[2] == 0 and 0 < got[3] < 300


def test_stages_are_what_plain_loops_give(spark, sf):
    """Every stage after the learned one, on its own input, against brute force and a public library."""
    import public_tokenizers
    import tiktoken
    from test_decontaminate import brute as brute_hits
    from test_jaccard_join import brute as brute_groups
    from test_suffix_dedup import brute as brute_spans

    from recollect.llm.decontaminate import normal_words
    from recollect.llm.pretokens import read_ranks

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    calm = stages["toxicity"](spark, docs, sf).checkpoint()
    before = {r["doc_id"]: r["text"] for r in calm.collect()}
    single = stages["jaccard_join"](spark, calm, sf).checkpoint()
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert texts == {i: before[i] for i, _, least in brute_groups(list(before.items())) if i == least}
    cut = stages["suffix_dedup"](spark, single, sf).checkpoint()
    want = {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in brute_spans(list(texts.items()), corpus_pipeline.PASSAGE_BYTES, "first").items()}
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert {i: r["text"] or "" for i, r in rows.items()} == want and want != {i: t or "" for i, t in texts.items()}
    assert all(r["n_chars"] == len(want[i]) for i, r in rows.items() if r["text"] != texts[i])
    clean = stages["decontaminate"](spark, cut, sf).checkpoint()
    items = [(str(r["item_id"]), normal_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    starts = {tuple(words[s : s + min(13, len(words))]) for _, words in items for s in range(max(1, len(words) - 12)) if words}
    kept = set()
    for i, text in want.items():
        words = normal_words(text)
        near = [(n, w) for n, w in items if any(tuple(words[p : p + min(13, len(w))]) in starts for p in range(len(words)))]
        hit = sum(brute_hits(words, near, 13)[0]) if near else 0
        if not (hit and 20 * hit >= len(words)):
            kept.add(i)
    assert {r["doc_id"] for r in clean.collect()} == kept
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(queries.rank_file()), special_tokens={})
    for r in stages["byte_bpe"](spark, clean, sf).collect():
        assert list(r["ids"]) == official.encode_ordinary(want[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_an_empty_table_stays_empty(spark, sf, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_through_all_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs.union(docs).coalesce(1).write.parquet(f"{tmp_path}/twice/documents.parquet")
    docs.write.parquet(f"{tmp_path}/once/documents.parquet")
    for name in ("labels", "benchmark"):
        for folder in ("once", "twice"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    once, twice = (sorted(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{folder}").select("doc_id", "n_tokens").collect())) for folder in ("once", "twice"))
    assert once == twice and once
