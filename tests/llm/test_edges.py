"""Extra columns that clash, empty tables, very long texts, repeated and keyless rows; learned scores against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recollect.llm import byte_bpe, chat_format, decontaminate, language, mpegts, queries, suffix_dedup, token_counts, toxicity, window_dedup
from recollect.llm.decontaminate import normal_words

TEXT = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def models(spark):
    labelled = [(i, f"{'bad' if i % 3 == 0 else 'good'} words here {i % 5}") for i in range(60)]
    docs = spark.createDataFrame(labelled, TEXT)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    langs = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de")], "text string, lang string")
    return toxicity.train(docs, labels), language.train(langs)


def operators(spark):
    """name -> (operator over documents, its result columns)"""
    fm, lm = models(spark)
    bench = spark.createDataFrame([("a", "cat dog")], "item_id string, text string")
    media = lambda df: mpegts.parsed(mpegts.stored(df.select("doc_id", mpegts.padded(df["text"]).alias("payload")), "payload"), carry=["doc_id"])
    return {
        "byte_bpe": (lambda df: byte_bpe.encoded(df, queries.rank_file(), outputs=["ids", "n_tokens"]), ["ids", "n_tokens"]),
        "toxicity": (lambda df: toxicity.scored(df, fm), ["score"]),
        "window_dedup": (lambda df: window_dedup.without_repeats(df, window=3), ["n_words", "removed", "kept"]),
        "suffix_dedup": (lambda df: suffix_dedup.without_repeats(df, length=64), ["n_bytes", "removed", "kept"]),
        "language": (lambda df: language.identified(df, lm), ["lang_pred", "score"]),
        "decontaminate": (lambda df: decontaminate.benchmark_hits(df, bench), ["n_words", "spans", "items"]),
        "mpegts": (media, ["samples", "units", "lost", "repeated", "broken", "feature"]),
        "token_counts": (lambda df: token_counts.token_counts(df, queries.rank_file()), ["n_pretokens", "n_tokens"]),
    }


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, "The cat and the dog", 7), (2, None, 8), (3, "", 9), (4, "der Hund", None), (4, "der Hund", None), (None, "a cat dog", 1)]
    plain = spark.createDataFrame([r[:2] for r in rows], TEXT)
    for name, (apply, results) in operators(spark).items():
        want = rows_of(apply(plain))
        assert len(want) == len(rows), name
        for extra in results + ["_text", "_key", "label", "key"]:
            got = apply(spark.createDataFrame(rows, f"{TEXT}, `{extra}` long"))
            assert got.columns == apply(plain).columns, (name, extra)
            if extra in (results[0], "_text"):
                assert rows_of(got) == want, (name, extra)
        assert rows_of(apply(plain.limit(0))) == [], name


def test_carried_columns_that_clash_are_errors(spark):
    """Every result column of every operator with carried columns, by name."""
    fm, lm = models(spark)
    benchmark = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    cases = {
        "byte_bpe": (lambda df, c: byte_bpe.encoded(df, queries.rank_file(), carry=[c], outputs=list(byte_bpe.OUTPUTS)), list(byte_bpe.OUTPUTS)),
        "toxicity": (lambda df, c: toxicity.scored(df, fm, carry=[c]), ["score"]),
        "window_dedup": (lambda df, c: window_dedup.without_repeats(df, carry=[c]), ["n_words", "removed", "kept"]),
        "suffix_dedup": (lambda df, c: suffix_dedup.without_repeats(df, carry=[c]), ["n_bytes", "removed", "kept"]),
        "language": (lambda df, c: language.identified(df, lm, carry=[c]), ["lang_pred", "score"]),
        "token_counts": (lambda df, c: token_counts.token_counts(df, queries.rank_file(), carry=[c]), ["n_pretokens", "n_tokens"]),
        "mpegts": (lambda df, c: mpegts.stored(df, "text", carry=[c]), ["media"]),
        "decontaminate": (lambda df, c: decontaminate.benchmark_hits(df, benchmark, key=c), ["n_words", "spans", "items"]),
    }
    for operator, (apply, names) in cases.items():
        for name in names:
            with pytest.raises(ValueError, match=name):
                apply(spark.createDataFrame([(1, "x", 1)], f"{TEXT}, {name} long"), name)
                raise AssertionError(f"{operator}: {name} is not protected")


def test_chat_columns_that_clash(spark):
    rows = [(0, 0, "user", "hi", 1), (0, 1, "assistant", "yes", 2), (1, 0, "user", "hi", 3), (1, 1, "assistant", "no", 4)]
    want = None
    for extra in ("other", "pair", "chosen", "n", "prompt", "conversation", "said"):
        df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, `{extra}` long")
        got = rows_of(chat_format.preference_pairs(chat_format.neighbours(df)))
        want = want or got
        assert got == want


def long_text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "été", "gamma", "the", "of"]) + str(r.randrange(10**6)) for _ in range(n))


def test_very_long_texts(spark):
    long = long_text(1, 150_000)
    head = long[:400_000]
    rows = [(1, long), (2, "short text"), (3, head), (4, head[100_000:300_000])]
    df = spark.createDataFrame(rows, TEXT)
    fm, lm = models(spark)
    assert [r["score"] for r in toxicity.scored(df, fm).collect()] != []
    assert {r["doc_id"]: r["lang_pred"] for r in language.identified(df, lm).collect()}.keys() == {1, 2, 3, 4}
    kept = {r["doc_id"]: r["kept"] for r in window_dedup.without_repeats(df).collect()}
    assert kept[1] == long and kept[2] == "short text" and len(kept[3].split()) <= 1 and len(kept[4].split()) <= 2
    bench = spark.createDataFrame([("x", " ".join(long.split()[70_000:70_020]))], "item_id string, text string")
    hits = {r["doc_id"]: (r["n_words"], r["spans"]) for r in decontaminate.benchmark_hits(df, bench).collect()}
    assert hits[1][0] == len(normal_words(long)) and [b - a for a, b in hits[1][1]] == [20] and hits[2][1] == []
    back = mpegts.parsed(mpegts.stored(df.select("doc_id", mpegts.padded(df["text"]).alias("payload")), "payload"), carry=["doc_id"])
    sizes = {r["doc_id"]: len(r["samples"]) for r in back.select("doc_id", "samples").collect()}
    assert sizes[1] == -(-len(long.encode()) // 64) * 64


@pytest.mark.parametrize("segment", [1 << 22, 5000])
def test_long_texts_are_cut_into_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    long = long_text(2, 4000)
    rows = [(1, long), (2, long[10_000:20_000]), (3, "x" + long[12_345:12_345 + 450] + "y"), (4, long.encode()[:399].decode("utf-8", "ignore"))]
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, TEXT).coalesce(1), keep="first").collect()}
    size = lambda t: len(t.encode())
    assert got == {1: [], 2: [(0, size(rows[1][1]))], 3: [(1, 1 + size(rows[2][1]) - 2)], 4: []}


def test_windows_of_rows_that_share_a_key(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b + " " + a), (2, b), (3, a)]
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in window_dedup.without_repeats(spark.createDataFrame(rows, TEXT)).collect())
    # rows of one key keep what they share; other documents are compared with both
    assert got == [(1, 30, a), (1, 60, b + " " + a), (2, 30, ""), (3, 30, "")]


def test_strings_of_rows_that_share_a_key(spark):
    a = long_text(3, 100)
    rows = [(1, a), (1, a + " more"), (2, a)]
    got = sorted((r["doc_id"], len(bytes(r["kept"]))) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, TEXT), keep="none").collect())
    assert got == [(1, 0), (1, 5), (2, 0)]  # different documents, whatever their key


def test_rows_without_a_key_are_held_out(spark, tmp_path):
    docs = [(i, f"{'bad' if i % 3 == 0 else 'good'} words here {i % 5}", "en") for i in range(60)] + [(None, "bad words", "en"), (None, None, None)]
    spark.createDataFrame(docs, f"{TEXT}, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, modulus, fold in ((queries.op3_toxicity, 4, 2), (queries.op6_language, 5, 0)):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(docs)
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold) for r in got)


def test_factorization_machine_is_the_sum_over_pairs():
    r = np.random.default_rng(3)
    n = 40
    rows = np.full(toxicity.BUCKETS, n, np.int32)
    rows[:n] = np.arange(n)
    weights, factors = np.append(r.normal(size=n), 0), np.vstack([r.normal(size=(n, 4)), np.zeros((1, 4))])
    model = toxicity.FactorizationMachine(0.3, rows, weights, factors)
    sets = [sorted(r.choice(n + 20, size=k, replace=False).tolist()) for k in (0, 1, 2, 9, 25)]
    got = model.logits(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.array(s, np.int64) for s in sets]), len(sets))
    for s, z in zip(sets, got, strict=True):
        known = [t for t in s if t < n]
        want = 0.3 + sum(weights[t] for t in known) + sum(float(factors[a] @ factors[b]) for i, a in enumerate(known) for b in known[:i])
        assert abs(want - z) < 1e-9


def plain_language(rows, texts):
    """The scores of the language operator, word by word."""
    words_of = lambda t: [w for w in re.findall(r"[^\W\d_]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    grams = lambda w, k: [w[i : i + 1] for i in range(len(w))] if k == 1 else [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]
    langs = sorted({lang for _, lang in rows if lang})
    counts = {lang: [Counter() for _ in range(6)] for lang in langs}
    for text, lang in rows:
        for w in words_of(text) if lang else ():
            counts[lang][0][w] += 1
            for k in range(1, 6):
                counts[lang][k].update(grams(w, k))
    known = [set().union(*(counts[lang][k] for lang in langs)) for k in range(6)]
    log = lambda lang, k, x: math.log((counts[lang][k][x] + 0.5) / (sum(counts[lang][k].values()) + 0.5 * max(1, len(known[k]))))
    out = []
    for text in texts:
        words = words_of(text)
        if not words:
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in words:
            for lang in langs:
                if w in known[0]:
                    total[lang] += log(lang, 0, w)
                    continue
                whole, value = f" {w} ", 0.0
                for i in range(len(whole)):
                    for k in range(5, 0, -1):
                        part = whole[i : i + k]
                        if len(part) == k and (k > 1 or 0 < i < len(whole) - 1) and part in known[k]:
                            value += log(lang, k, part)
                            break
                total[lang] += value / (len(w) + 1)
        best = max(langs, key=lambda lang: (total[lang], -langs.index(lang)))
        out.append((best, 1 / sum(math.exp(x - total[best]) for x in total.values())))
    return out


def test_language_is_the_plain_backoff(spark):
    r = random.Random(4)
    syllables = {"aa": ["ba", "bé", "lo", "x"], "bb": ["ba", "ku", "ö", "zz"], "cc": ["lo", "ku", "mi"]}
    say = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(n))
    rows = [(say(lang, 30).title() if i % 2 else say(lang, 30), lang) for i in range(4) for lang in syllables] + [("nothing", None)]
    texts = [say(r.choice(sorted(syllables)), r.randint(1, 6)) + r.choice(["", "-7", " Unseen Words", " qqq"]) for _ in range(80)] + [None, "", "12 !", "QQ"]
    model = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identified(spark.createDataFrame(list(enumerate(texts)), TEXT), model).collect()}
    for i, (lang, score) in enumerate(plain_language(rows, texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, (texts[i], got[i], lang, score)


def test_language_keeps_the_most_frequent(spark):
    rows = [("aa " * 5 + "bb " * 4 + "cc " * 3 + "dd ee ff gg hh", "xx")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), words=3, grams=1000)
    assert len(model.tables[0][0]) == 3
    assert len(language.train(spark.createDataFrame(rows, "text string, lang string"), words=100).tables[0][0]) == 8


def test_media_digests(spark, tmp_path):
    texts = [None, "", "é" * 100, "x" * 5000, "y" * 63, "z" * 64]
    spark.createDataFrame(list(enumerate(texts)), TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op9_mpegts(spark, str(tmp_path)).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(mpegts.store(payload)).hexdigest()
