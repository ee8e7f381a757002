"""Fingerprints against plain arithmetic, and on strings that collide modulo powers of two."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from recollect.llm import byte_bpe, jaccard_join, language, suffix_dedup, textbatch, token_counts, window_dedup
from recollect.llm.pretokens import read_ranks
from recollect.llm.queries import rank_file


def thue_morse(n):
    """Two complementary words of 2**n letters."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def buffer(*texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_products_and_spans_against_whole_numbers():
    r = random.Random(1)
    numbers = [0, 1, textbatch.PRIME - 1, *(r.randrange(textbatch.PRIME) for _ in range(500))]
    a, b = np.array(numbers, np.uint64), np.array(numbers[::-1], np.uint64)
    assert textbatch._times(a, b).tolist() == [x * y % textbatch.PRIME for x, y in zip(numbers, numbers[::-1], strict=True)]
    data = bytes(r.randrange(256) for _ in range(3000))
    spans = [sorted((r.randint(0, 3000), r.randint(0, 3000))) for _ in range(300)]
    starts, ends = np.array(spans).T
    want = [sum((v + 1) * pow(textbatch._BASES[0], k, textbatch.PRIME) for k, v in enumerate(data[s:e])) % textbatch.PRIME for s, e in spans]
    sums = textbatch.byte_sums(np.frombuffer(data, np.uint8))
    assert textbatch.span_hashes(sums, starts, ends).tolist() == textbatch.mix(np.array(want, np.uint64)).tolist()
    sums.longest = 7  # as for spans that are longer than running sums are exact
    assert textbatch.span_hashes(sums, starts, ends).tolist() == textbatch.mix(np.array(want, np.uint64)).tolist()


@pytest.mark.parametrize("n", [10, 11, 12])
def test_complementary_words_differ(n):
    x, y = thue_morse(n)
    buf, offs = buffer(x, y)
    h = textbatch.span_hashes(textbatch.byte_sums(buf), offs[:-1], offs[1:])
    assert h[0] != h[1]
    words = np.array([7 if c == "a" else 1 << 60 for c in x + y], np.uint64)
    w, _ = textbatch.window_hashes(words, np.zeros(2 * len(x), np.int64), len(x))
    assert w[0] != w[len(x)]
    d, s = jaccard_join.shingle_sets(buf, offs, 5)
    assert d.tolist() == [0, 1] and s[0] != s[1]


def test_one_hash_for_all(monkeypatch):
    """Where all hashes are equal, bytes decide."""
    monkeypatch.setattr(textbatch, "span_hashes", lambda sums, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["the cat saw the cat, café", "a dog and the cat", "", "dog " * 9]
    codec = byte_bpe.BytePairCodec(read_ranks(rank_file()))
    counter = token_counts.UnigramCounter({bytes([b]): b for b in range(256)})
    ranks = read_ranks(rank_file())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(2):
        buf, offs = buffer(*texts)
        ids, bounds = codec.encode(buf, offs)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [encoding.encode_ordinary(t) for t in texts]
        starts, ends, _ = byte_bpe.pretokens(buf, offs)
        number, _ = counter.seen.number(buf, starts, ends)
        contents = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert len({*zip(number.tolist(), contents, strict=True)}) == len(set(contents))


def test_operators_on_complementary_words(spark):
    x, y = thue_morse(10)
    z, w = thue_morse(12)
    rest = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, z), (6, w)], "doc_id long, text string").repartition(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ranks = read_ranks(rank_file())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encoded(docs, rank_file(), outputs=["ids", "decoded_sha256"]).collect():
        assert r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert {r["doc_id"]: len(r["removed"]) for r in window_dedup.without_repeats(docs).collect()} == dict.fromkeys(texts, 0)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(docs).collect()} == {k: 1 if k == 2 else k for k in texts}  # 1 and 2 share 15 of 17 shingles
    repeats = {d: [s[i : i + 1500] for i in range(len(s) - 1499)] for d, s in texts.items()}
    want = {d: any(s in other for s in own for e, other in texts.items() if e != d) or len(set(own)) < len(own) for d, own in repeats.items()}
    found = suffix_dedup.without_repeats(docs, keep="none", length=1500).collect()
    assert {r["doc_id"]: bool(r["removed"]) for r in found} == want
    counts = token_counts.token_counts(docs, rank_file()).collect()
    counter = token_counts.UnigramCounter(ranks)
    assert {r["doc_id"]: r["n_tokens"] for r in counts} == {d: sum(counter.count_one(p) for p in pretoken_bytes(t)) for d, t in texts.items()}
    learned = docs.where("doc_id in (3, 4)").selectExpr("doc_id", "text", "if(doc_id = 3, 'aa', 'bb') as lang")
    model = language.train(learned)
    assert {r["doc_id"]: r["lang_pred"] for r in language.identified(learned, model).collect()} == {3: "aa", 4: "bb"}


def pretoken_bytes(text):
    buf, offs = buffer(text)
    starts, ends, _ = byte_bpe.pretokens(buf, offs)
    return [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
