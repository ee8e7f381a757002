"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words, words that it has twice or more, and
the first bytes of longer words, hashed into a fixed number of buckets.  The machine
scores w0 + sum w[t] + sum over pairs <v[s], v[t]>, so that terms that only mean harm
together, such as an insult with the mention of a group, count as a pair; the pairwise
sum is computed from sums and sums of squares, in time linear in the terms.

The model is fitted on the driver, on at most ``rows`` labelled documents: the bound
``TRAINING_ROWS`` is a parameter, and the sample is the labelled documents with the least
hash of their id.  Terms in fewer than ``LEAST_DOCUMENTS`` of them do not count, and of the
others the ``MODEL_TERMS`` that tell the classes apart best.  Scoring covers whole texts of all
rows in one pass without a shuffle.

Defined results: null counts as empty text; an empty text scores the model's bias, between
0 and 1 like any other; labels that are null, or for which no document exists, are left
out; with several labels for a document the largest counts; with labels of one class (or
none) every score is that class's share (0 for none); rows that repeat score alike;
carried columns keep their values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.shipping import ship
from recollect.llm.textbatch import LOWER, NON_LETTER, byte_sums, pieces, span_hashes, words

BUCKETS = 1 << 20
TRAINING_ROWS = 12_000
LEAST_DOCUMENTS, MODEL_TERMS = 4, 8_192
FACTORS, EPOCHS, BATCH = 6, 20, 256
#: A toxic row weighs as much as this many others: toxic rows are few, and their rare terms would score too low.
TOXIC_WEIGHT = 6.0
RATE, SHRINK_WEIGHTS, SHRINK_FACTORS = 0.1, 1e-4, 1e-3
BEGINNINGS = (5, 7)


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, bucket) pairs of a run of documents, in order."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, doc = words(buf, offs, NON_LETTER)
    sums = byte_sums(buf, LOWER)
    own = span_hashes(sums, starts, ends)
    bucket = lambda h, kind: ((h ^ np.uint64(kind * 0x9E3779B9)) >> np.uint64(7)).astype(np.int64) % BUCKETS
    found = [doc * BUCKETS + bucket(own, 0)]
    for size in BEGINNINGS:
        long = ends - starts > size
        found.append(doc[long] * BUCKETS + bucket(span_hashes(sums, starts[long], starts[long] + size), size))
    pairs, n = np.unique(found[0], return_counts=True)
    again = pairs[n > 1]
    found[0] = pairs
    found.append(again // BUCKETS * BUCKETS + (again % BUCKETS * 0x2545F491 + 11) % BUCKETS)
    return np.divmod(np.unique(np.concatenate(found)), BUCKETS)


@dataclass
class FactorizationMachine:
    bias: float
    #: bucket -> row of the parameters, or the last row, which is zero
    rows: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        row = self.rows[bucket]
        used = row < len(self.weights) - 1
        return self._logits(doc[used], row[used], n)

    def _logits(self, doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.weights[row], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[row, k]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, *, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss; doc is sorted and numbers the labels."""
    n, share = len(label), float(label.mean()) if len(label) else 0.0
    rows = np.zeros(BUCKETS, np.int32)
    if share in (0.0, 1.0):
        return FactorizationMachine(-30.0 if share == 0 else 30.0, rows, np.zeros(1), np.zeros((1, FACTORS)))
    count = np.bincount(bucket, minlength=BUCKETS)
    toxic = np.bincount(bucket, label[doc], BUCKETS)
    expected = count * share
    gain = np.where(count >= LEAST_DOCUMENTS, (toxic - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    best = np.argsort(-gain, kind="stable")[:MODEL_TERMS]
    best = np.sort(best[gain[best] > 1])
    rows[:] = len(best)
    rows[best] = np.arange(len(best))
    row = rows[bucket]
    used = row < len(best)
    doc, row = doc[used], row[used]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(best) + 1), random.normal(0, 0.01, (len(best) + 1, FACTORS))
    v[-1] = 0
    bias, gw, gv, gb = float(np.log(share / (1 - share))), np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for lo in range(0, n, BATCH):
            some = order[lo : lo + BATCH]
            size = bounds[some + 1] - bounds[some]
            at = np.repeat(bounds[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            d, r = np.repeat(np.arange(len(some)), size), row[at]
            vr = v[r]
            sums = np.stack([np.bincount(d, vr[:, k], len(some)) for k in range(FACTORS)], 1)
            squares = np.bincount(d, (vr**2).sum(1), len(some))
            z = bias + np.bincount(d, w[r], len(some)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (sigmoid(z) - label[some]) * np.where(label[some] > 0, TOXIC_WEIGHT, 1.0) / len(some)
            e = error[d]
            dw = np.bincount(r, e, len(w)) + SHRINK_WEIGHTS * w * (np.bincount(r, minlength=len(w)) > 0)
            slope = e[:, None] * (sums[d] - vr)
            dv = np.stack([np.bincount(r, slope[:, k], len(w)) for k in range(FACTORS)], 1) + SHRINK_FACTORS * v * (dw != 0)[:, None]
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + error.sum() ** 2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
            bias -= RATE * error.sum() / gb**0.5
    w[-1], v[-1] = 0, 0
    return FactorizationMachine(bias, rows, w, v)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches, "_text"):
        doc, bucket = terms(buf, offs)
        bounds = np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), lists], names=["label", "place", "terms"])


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents."""
    ship(documents.sparkSession)
    sample = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    sample = sample.withColumn("_place", F.xxhash64("_key")).orderBy("_place").limit(rows)
    docs = documents.select(F.col(key).alias("_own"), F.col(text).alias("_text"))
    texts = docs.join(F.broadcast(sample), F.col("_own") == F.col("_key"))  # at most `rows` rows
    found = texts.select("_text", "_label", "_place").mapInArrow(_featurised, "label int, place bigint, terms array<int>").toArrow().combine_chunks()
    found = found.sort_by("place")
    lists = found.column("terms").combine_chunks()
    bucket = lists.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return fit(doc, bucket, found.column("label").to_numpy().astype(float))


_models: dict[str, FactorizationMachine] = {}


def _model(token: str, shared) -> FactorizationMachine:
    """The worker's model, read once."""
    if token not in _models:
        _models.clear()
        _models[token] = FactorizationMachine(*shared.value)
    return _models[token]


def scored(df: DataFrame, model: FactorizationMachine, *, text: str = "text", carry: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The carried columns (they may include the text) and the probability that a text is toxic."""
    if name in carry:
        raise ValueError(f"a carried column is named {name}")
    ship(df.sparkSession)
    shared, token = df.sparkSession.sparkContext.broadcast((model.bias, model.rows, model.weights, model.factors)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = _model(token, shared)
        for rows, buf, offs in pieces(batches, "_text"):
            score = sigmoid(model_.logits(*terms(buf, offs), rows.num_rows))
            yield pa.RecordBatch.from_arrays(rows.columns[1:] + [pa.array(score)], names=rows.schema.names[1:] + [name])

    rows = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [f"`{name}` double"])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})
