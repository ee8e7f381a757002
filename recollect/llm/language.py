"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts words (maximal runs of letters, A-Z lower-cased) and the n-grams of
those words by language over all training rows, with partial counts in the tasks.  The
model keeps each language's most frequent words and n-grams (``MODEL_WORDS``, ``MODEL_GRAMS``),
an entry for each language that has the word: its size is so many entries for each language.
Less frequent words count as unseen.  With more languages than MODEL_ENTRIES allow, training
is an error that says so.

A word that is known in some language scores its log frequency in each.  An unseen word
is covered by n-grams: at every position the longest n-gram that is known in some
language counts, from five characters (the word stands between blanks) down to one.  A
text's score is the sum over its words; the prediction is the best language, and the
score is its share of the posterior under equal priors.

Defined results: null text, and text without a letter, is ``und`` with score 0; ties go
to the language first in order; with no training rows everything is ``und``; rows with a
null language do not train; rows that repeat count each time; carried columns keep their
values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from recollect.llm.pretokens import LETTER, character_classes
from recollect.shipping import ship
from recollect.llm.textbatch import characters, pieces, prefix_sums, ragged, runs, span_hashes

LONGEST = 5
#: Words and n-grams of each length that the model keeps by language.
MODEL_WORDS, MODEL_GRAMS = 50_000, 20_000
#: Entries that a model may have at most, with some 20 bytes each: 266 languages of that size.
MODEL_ENTRIES = 40_000_000
#: Counts that a task gathers before it hands them on.
GATHERED = 1_000_000


def _character_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash sums of the characters (non-letters as blanks), and each word's start, end and document."""
    cp, at = characters(buf)
    letter = character_classes()[cp] == LETTER
    border = np.searchsorted(at, offs)
    starts, ends, doc = runs(letter, border)
    cp = np.where(letter, np.where((cp >= 65) & (cp <= 90), cp + 32, cp), 0x20)
    # a blank before every document and one after the last, so that no word touches another document's
    cp = np.append(np.insert(cp, border[:-1], 0x20), 0x20).astype(np.uint64)
    return prefix_sums(cp + np.uint64(1), 0, 22), starts + doc + 1, ends + doc + 1, doc


def _grams(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams with a blank at both ends (single letters without), and each one's word."""
    lo, hi = (starts, ends) if n == 1 else (starts - 1, ends + 1)
    count = np.maximum(hi - lo - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(lo, count) + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    return span_hashes(sums, at, at + n), word


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, hash, n) of a task's rows: kind 0 for words, else the n-gram's length."""
    held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def handed() -> Iterator[pa.RecordBatch]:
        for (kind, lang), parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "lang", "hash", "n"])
        held.clear()

    for rows, buf, offs in pieces(batches, "_text"):
        if not len(buf):
            continue
        sums, starts, ends, doc = _character_words(buf, offs)
        langs = np.array(rows.column(1).to_pylist(), object)
        for lang in set(langs.tolist()):
            own = (langs == lang)[doc]
            words, first, n = np.unique(span_hashes(sums, starts[own], ends[own]), return_index=True, return_counts=True)
            held.setdefault((0, lang), []).append((words, n))
            size += len(words)
            lo, hi = starts[own][first], ends[own][first]
            for k in range(1, LONGEST + 1):
                h, word = _grams(sums, lo, hi, k)
                keys, which = np.unique(h, return_inverse=True)
                held.setdefault((k, lang), []).append((keys, np.bincount(which, n[word], len(keys))))
                size += len(keys)
        if size > 4 * GATHERED:
            held = {key: [merged(parts)] for key, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > GATHERED:
                yield from handed()
                size = 0
    yield from handed()


class Entries(NamedTuple):
    """Of one kind: sorted hashes, and for each the languages that have it with what it scores there beyond ``rest``."""

    keys: np.ndarray
    #: where each key's entries begin, and the end
    begin: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    #: by language: the log frequency of what it doesn't have
    rest: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the places of those."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return known, at[known]

    def add(self, out: np.ndarray, row: np.ndarray, at: np.ndarray) -> None:
        """Add the scores of the keys at some places to rows of out (rows by languages)."""
        n = len(self.rest)
        size = self.begin[at + 1] - self.begin[at]
        some = ragged(self.begin[at], size)
        own = np.bincount(np.repeat(row, size) * n + self.lang[some], self.value[some], out.size)
        out += own.reshape(out.shape) + np.bincount(row, minlength=len(out))[:, None] * self.rest


@dataclass
class LanguageModel:
    """By kind: entries of words, then of n-grams."""

    langs: list[str]
    tables: list[Entries]

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's sum of log frequencies by language, and whether it has a letter."""
        n = len(offs) - 1
        total, any_letter = np.zeros((n, len(self.langs))), np.zeros(n, bool)
        if not len(buf) or not self.langs:
            return total, any_letter
        sums, starts, ends, doc = _character_words(buf, offs)
        any_letter[doc] = True
        distinct, first, which = np.unique(span_hashes(sums, starts, ends), return_index=True, return_inverse=True)
        value = np.zeros((len(distinct), len(self.langs)))
        known, at = self.tables[0].find(distinct)
        self.tables[0].add(value, np.flatnonzero(known), at)
        unseen = np.flatnonzero(~known)
        if len(unseen):
            value[unseen] = self._backed_off(sums, starts[first[unseen]], ends[first[unseen]])
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, value[which, k], n)
        return total, any_letter

    def _backed_off(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unseen words: at every start the longest known n-gram counts."""
        out = np.zeros((len(starts), len(self.langs)))
        size = ends - starts + 2
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(starts)), size)
        at = np.repeat(starts - 1, size) + np.arange(len(word)) - np.repeat(begin, size)
        left = ends[word] + 1 - at  # characters from here to the closing blank, with it
        for k in range(LONGEST, 0, -1):
            fits = left >= k
            if k == 1:
                fits &= (at >= starts[word]) & (at < ends[word])
            some = np.flatnonzero(fits)
            known, where = self.tables[k].find(span_hashes(sums, at[some], at[some] + k))
            self.tables[k].add(out, word[some[known]], where)
            keep = np.ones(len(at), bool)
            keep[some[known]] = False
            at, word, left = at[keep], word[keep], left[keep]
        return out / (ends - starts + 1)[:, None]


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", words: int = MODEL_WORDS, grams: int = MODEL_GRAMS) -> LanguageModel:
    """Counts over all rows with a language; the model has a fixed size for each language."""
    ship(rows.sparkSession)
    parts = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).mapInArrow(_counts, "kind int, lang string, hash bigint, n bigint")
    counts = parts.groupBy("kind", "lang", "hash").agg(F.sum("n").alias("n"))
    # how many words have which count tells from which count on a language keeps them; of those at the edge a share, by hash
    tally = counts.groupBy("kind", "lang", "n").agg(F.count("*").alias("size"))
    above = F.sum("size").over(Window.partitionBy("kind", "lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    room = F.when(F.col("kind") == 0, words).otherwise(grams) - F.coalesce(above, F.lit(0))
    edge = tally.withColumn("share", room / F.col("size")).where("share > 0").groupBy("kind", "lang").agg(F.min_by("share", "n").alias("share"), F.min("n").alias("least"))
    langs = sorted(r["lang"] for r in rows.select(F.col(lang).cast("string").alias("lang")).where("lang is not null").distinct().limit(MODEL_ENTRIES // (words + LONGEST * grams) + 1).collect())
    if len(langs) * (words + LONGEST * grams) > MODEL_ENTRIES:
        raise ValueError(f"more languages than a model of {MODEL_ENTRIES} entries holds: keep fewer words and n-grams of each")
    numbers = rows.sparkSession.createDataFrame(list(zip(langs, range(len(langs)), strict=True)), "lang string, number smallint")
    found = counts.join(F.broadcast(edge), ["kind", "lang"]).join(F.broadcast(numbers), "lang")  # a row for each kind and language
    drawn = F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    found = found.where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & drawn)).select(F.col("kind").cast("tinyint").alias("kind"), "number", "hash", "n").toArrow()
    kind, number, hashes, n = (found.column(c).to_numpy() for c in ("kind", "number", "hash", "n"))
    seen = np.unique(number)  # languages without any word can't be told
    langs, number = [langs[k] for k in seen], np.searchsorted(seen, number)
    tables = []
    for k in range(LONGEST + 1):
        own = np.flatnonzero(kind == k)
        own = own[np.lexsort((number[own], hashes[own].view(np.uint64)))]
        h, lang = hashes[own].astype(np.int64).view(np.uint64), number[own].astype(np.int64)
        keys, begin = np.unique(h, return_index=True)
        sums = np.bincount(lang, n[own], len(langs)) + 0.5 * max(1, len(keys))
        value = (np.log(n[own] + 0.5) - np.log(0.5)).astype(np.float32)
        tables.append(Entries(keys, np.append(begin, len(h)), lang.astype(np.int16), value, np.log(0.5 / sums)))
    return LanguageModel(langs, tables)


_models: dict[str, LanguageModel] = {}


def _model(token: str, shared) -> LanguageModel:
    """The worker's model, read once."""
    if token not in _models:
        _models.clear()
        _models[token] = LanguageModel(*shared.value)
    return _models[token]


def identified(df: DataFrame, model: LanguageModel, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score."""
    if clash := set(carry) & {"lang_pred", "score"}:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    ship(df.sparkSession)
    shared, token = df.sparkSession.sparkContext.broadcast((model.langs, model.tables)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(token, shared)
        for rows, buf, offs in pieces(batches, "_text"):
            total, letter = m.score(buf, offs)
            if m.langs:
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                names = np.where(letter, np.array(m.langs, object)[best], "und")
            else:
                names, share = np.full(len(offs) - 1, "und", object), np.zeros(len(offs) - 1)
            found = [pa.array(names.tolist(), pa.string()), pa.array(np.where(letter, share, 0.0))]
            yield pa.RecordBatch.from_arrays(rows.columns[1:] + found, names=rows.schema.names[1:] + ["lang_pred", "score"])

    rows = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + ["lang_pred string, score double"])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})
