"""Language and toxicity: held-out accuracy, and special rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import language, queries, toxicity


def test_languages_of_held_out_documents(spark, sf):
    got = queries.op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_rules(spark):
    rows = [("das ist ein Haus und der Baum", "de"), ("the house and the tree is here", "en"), ("x", None)] * 3
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ..."), (4, "THE TREE"), (5, "Baum Haus der"), (6, "漢字")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(asked, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de" and got[6][0] in ("de", "en")
    none = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.identified(asked, none).collect()} == {"und"}
    assert language.identified(asked.limit(0), model).count() == 0


def test_unseen_words_back_off(spark):
    rows = [("schule schaf schiff", "de"), ("queue quiet quick", "en")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(1, "schatz"), (2, "quirk")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identified(asked, model).collect()} == {1: "de", 2: "en"}


def test_machine_learns_pairs():
    """Either of two terms alone speaks against the label, both together for it: no sum of weights does that."""
    r = random.Random(1)
    doc, bucket, label = [], [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        terms = sorted({10 * a, 20 * b, 100 + r.randrange(30)} - {0})
        doc += [i] * len(terms)
        bucket += terms
        label.append(float(a and b or not (a or b) and r.random() < 0.4))
    model = toxicity.fit(np.array(doc), np.array(bucket), np.array(label))
    score = lambda *t: toxicity.sigmoid(model.logits(np.zeros(len(t), int), np.array(t), 1))[0]
    assert score(10, 20) > 0.95 and max(score(10), score(20)) < 0.5 < score(101)


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").collect()
    toxic, calm = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in calm]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!"), (4, "word " * 10)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(odd, model).collect())


def test_training_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "x")], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1), (None, 1), (9, 0), (1, None)], 1.0), ([(2, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {round(r["score"], 6) for r in toxicity.scored(docs, model).collect()} == {want}


def test_folds(spark):
    import zlib

    rows = spark.range(200).withColumn("doc_id", F.col("id")).select("doc_id", queries.remainder("doc_id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_a_model_of_two_hundred_languages(spark, monkeypatch):
    """Its size follows the entries, not the square of the languages; too many languages are an error."""
    import random

    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{k:03d}": ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(60)] for k in range(200)}
    rows = [(n, " ".join(r.choices(words, k=40)), lang) for n, (lang, words) in enumerate((lang, words) for lang, words in vocab.items() for _ in range(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    entries = sum(len(t.lang) for t in model.tables)
    size = sum(x.nbytes for t in model.tables for x in (t.keys, t.begin, t.lang, t.value, t.rest))
    assert len(model.langs) == 200 and size <= 24 * entries + 200 * 8 * 6 + 64
    found = {x["doc_id"]: x["lang_pred"] for x in language.identified(docs, model).collect()}
    assert sum(found[n] == lang for n, _, lang in rows) >= 0.99 * len(rows)
    monkeypatch.setattr(language, "MODEL_ENTRIES", 199 * (language.MODEL_WORDS + language.LONGEST * language.MODEL_GRAMS))
    with pytest.raises(ValueError, match="more languages"):
        language.train(docs)


def plain_terms(text):
    """The distinct buckets of one text: words, words that repeat, and beginnings of 5 and 7 bytes."""
    import re

    from recollect.llm.textbatch import byte_sums, span_hashes

    def bucket(word, kind):
        h = int(span_hashes(byte_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))[0])
        return (h ^ (kind * 0x9E3779B9)) // 128 % toxicity.BUCKETS

    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
    own = [bucket(w, 0) for w in words]
    out = set(own) | {bucket(w[:size], size) for w in words for size in (5, 7) if len(w) > size}
    return out | {(b * 0x2545F491 + 11) % toxicity.BUCKETS for b in own if own.count(b) > 1}


def test_terms_against_a_plain_loop():
    from recollect.llm.textbatch import pieces
    import pyarrow as pa

    texts = ["You fool, YOU foolish fools!", None, "", "Überraschung été 12 été", "a-b a_b abcdefgh ABCDEFGHI", "x" * 3000 + " y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["_text"])
    for _, buf, offs in pieces([batch], "_text"):
        doc, bucket = toxicity.terms(buf, offs)
        assert [set(bucket[doc == k].tolist()) for k in range(len(texts))] == [plain_terms(t) for t in texts]


def test_fit_against_a_plain_loop(monkeypatch):
    """The same steps of Adagrad, number by number."""
    import math

    for name, value in (("EPOCHS", 3), ("BATCH", 5), ("FACTORS", 2), ("LEAST_DOCUMENTS", 2)):
        monkeypatch.setattr(toxicity, name, value)
    r = random.Random(3)
    label = [int(r.random() < 0.3) for _ in range(23)]
    docs = [sorted({r.randrange(6) + (50 if y and r.random() < 0.8 else 0) for _ in range(r.randint(0, 5))}) for y in label]
    model = toxicity.fit(np.array([d for d, own in enumerate(docs) for _ in own]), np.array([b for own in docs for b in own]), np.array(label, float))
    share = sum(label) / len(label)
    gain = {}
    for b in {b for own in docs for b in own}:
        holders = [y for own, y in zip(docs, label, strict=True) if b in own]
        expected = len(holders) * share
        gain[b] = (sum(holders) - expected) ** 2 / (expected * (1 - share)) if len(holders) >= 2 else 0
    best = sorted(b for b in gain if gain[b] > 1)
    assert best and len(best) < len(gain)
    random_ = np.random.default_rng(7)
    w, v = [0.0] * len(best), random_.normal(0, 0.01, (len(best) + 1, 2))[:-1].tolist()
    bias, gb, gw, gv = math.log(share / (1 - share)), 1e-2, [1e-2] * len(best), [[1e-2] * 2 for _ in best]
    for _ in range(3):
        order = random_.permutation(len(label)).tolist()
        for lo in range(0, len(label), 5):
            some = order[lo : lo + 5]
            dw, dv, touched, total = [0.0] * len(best), [[0.0] * 2 for _ in best], set(), 0.0
            for d in some:
                own = [best.index(b) for b in docs[d] if b in best]
                sums = [sum(v[i][k] for i in own) for k in range(2)]
                z = bias + sum(w[i] for i in own) + 0.5 * sum(sums[k] ** 2 - sum(v[i][k] ** 2 for i in own) for k in range(2))
                error = (1 / (1 + math.exp(-z)) - label[d]) * (toxicity.TOXIC_WEIGHT if label[d] else 1) / len(some)
                total += error
                for i in own:
                    touched.add(i)
                    dw[i] += error
                    for k in range(2):
                        dv[i][k] += error * (sums[k] - v[i][k])
            for i in touched:
                dw[i] += toxicity.SHRINK_WEIGHTS * w[i]
                for k in range(2):
                    dv[i][k] += toxicity.SHRINK_FACTORS * v[i][k]
            gb += total**2
            for i in range(len(best)):
                gw[i] += dw[i] ** 2
                w[i] -= toxicity.RATE * dw[i] / math.sqrt(gw[i])
                for k in range(2):
                    gv[i][k] += dv[i][k] ** 2
                    v[i][k] -= toxicity.RATE * dv[i][k] / math.sqrt(gv[i][k])
            bias -= toxicity.RATE * total / math.sqrt(gb)
    assert math.isclose(model.bias, bias, rel_tol=1e-9)
    assert np.allclose(model.weights[:-1], w, rtol=1e-9) and np.allclose(model.factors[:-1], v, rtol=1e-9)
