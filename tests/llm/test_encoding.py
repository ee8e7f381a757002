"""Byte-level BPE against the public library, token counts against plain dynamic programming."""

import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from recollect.llm import byte_bpe, queries, token_counts
from recollect.llm.pretokens import pretokens, read_ranks
from recollect.llm.textbatch import pieces

RANKS = read_ranks(queries.rank_file())
OFFICIAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    r = random.Random(5)
    letters = "ab'sdtrelvm  \n\t\r\x0b é漢12٣.,!?-—😀ͅ\x85\xa0 ‍\x00\x1c"
    fixed = ["", "a", " ", "  ", "\n", "' s", "'s", "it's", "''s", "'S", "x'there", "a  b", "a \n b ", "a\n\nb", "\n'll!'d", "a" * 500, "word" * 300, "é" * 1000, " " * 300 + "x", "!" * 700, "<|endoftext|>"]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]


def batches(texts, size=1 << 20):
    return pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], max_bytes=size)


def test_pretokens_are_the_patterns_matches():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = odd_texts()
    got = []
    for rows, buf, offs in batches(texts, 700):
        starts, ends, doc = pretokens(buf, offs)
        parts = [[] for _ in range(rows.num_rows)]
        for a, b, d in zip(starts.tolist(), ends.tolist(), doc.tolist(), strict=True):
            parts[d].append(buf[a:b].tobytes().decode())
        got += parts
    assert got == [pattern.findall(t) for t in texts]


def test_codec_is_the_library():
    codec = byte_bpe.BytePairCodec(RANKS)
    texts = odd_texts()
    got = []
    for _, buf, offs in batches(texts, 5000):
        ids, bounds = codec.encode(buf, offs)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [OFFICIAL.encode_ordinary(t) for t in texts]
    assert [codec.decode(x).decode() for x in got] == texts


def test_one_tree_and_many_trees_agree():
    codec = byte_bpe.BytePairCodec(RANKS)
    r = random.Random(8)
    words = [bytes(r.choice(b"therandomi\xc3\xa9 ") for _ in range(r.randint(1, 64))) for _ in range(400)]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    ids, begin, counts = codec.encode_spans(buf, ends - [len(w) for w in words], ends)
    assert [ids[b : b + n].tolist() for b, n in zip(begin, counts, strict=True)] == [codec.encode_one(w) for w in words]


def test_frames(spark):
    rows = [(1, None, "x"), (1, "Hello there", "y"), (1, "Hello there", "y"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pretokens string")
    enc = byte_bpe.encoded(df, queries.rank_file(), outputs=["ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])
    for r in enc.collect():
        ids = list(r["ids"])
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert ids == OFFICIAL.encode_ordinary(bytes(r["decoded"]).decode())
    back = byte_bpe.decoded(enc.select("doc_id", "ids"), queries.rank_file())
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == [b"", b"", b"Hello there", b"Hello there"]
    assert byte_bpe.encoded(df.limit(0), queries.rank_file()).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(df, queries.rank_file(), carry=["n_pretokens"])


def test_counts_are_the_best_cuts(spark):
    scores = {t: token_counts.piece_score(r) for t, r in RANKS.items()}

    def best(word):
        @lru_cache(None)
        def cut(i):
            return max((scores[word[i:j]] + cut(j)[0], cut(j)[1] - 1) for j in range(i + 1, len(word) + 1) if word[i:j] in scores) if i < len(word) else (0, 0)

        return -cut(0)[1]

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t for t in odd_texts()[:300] if len(t) < 200] + ["the quick brown foxes", "unbelievable internationalisation " * 5]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(df, queries.rank_file()).collect()}
    for i, t in enumerate(texts):
        words = pattern.findall(t)
        assert got[i] == (len(words), sum(best(w.encode()) for w in words))
    assert got[len(texts)] == (0, 0)


def test_long_pretokens_outside_the_trie():
    counter = token_counts.UnigramCounter(RANKS)
    words = [b"a" * 64, b"ab" * 40, b"x" * 65]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert counter.count_spans(buf, ends - [len(w) for w in words], ends).tolist() == [counter.count_one(w) for w in words]
