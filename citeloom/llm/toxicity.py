"""Operator 7: toxicity by FTRL-proximal logistic regression.

Features are hashed word 1-grams, 2-grams and skip-grams (one word left out), lower case, present or
absent. Per-coordinate rates and L1 keep few weights, which are broadcast: their number is bounded by
the hash space of 2**20.

The model is fitted on at most `sample` labelled training rows, chosen by a hash of the id (a
documented bound, all rows where fewer are labelled); everything is scored.

Defined results: a null or empty text has no features and scores the bias alone; without labelled rows
the model scores every text 0.5; a document with several label rows counts as toxic if one says so;
null labels are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import utf8

BITS = 20
SPACE = 1 << BITS
MASK = np.uint64(SPACE - 1)
SAMPLE = 16_000
THRESHOLD = 0.3
_MARKS = b".,;:!?\"'()[]"


class Crc(dict):
    """word -> 32-bit hash of the word without the punctuation around it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = zlib.crc32(word.strip(_MARKS))
        return h


def features(text: bytes | None, seen: Crc) -> np.ndarray:
    """Hashed positions of all 1-grams, 2-grams and skip-grams, with repeats."""
    w = text.lower().split() if text else []
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - BITS)
    skip = ((h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:]) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BITS)
    return np.concatenate([one, two, skip]).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.1, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """(positions, weights, bias) of the nonzero weights after `epochs` over (features, label) in the order given."""
    if l1 is None:  # what a feature gathers by chance grows with the square root of the rows
        l1 = 0.2 * len(rows) ** 0.5
    z, n, bias, bias_n = np.zeros(SPACE), np.zeros(SPACE), 0.0, 0.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    rows = [(np.unique(x), y) for x, y in rows]
    for _ in range(epochs):
        for x, y in rows:
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            root = np.sqrt(n[x])
            after = np.sqrt(n[x] + g * g)
            z[x] += g - (after - root) / alpha * w
            n[x] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    every = np.flatnonzero(np.abs(z) > l1)
    return every.astype(np.int32), weights(every).astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on rows of labels (doc_id, toxic), all of which are taken for training rows."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.withColumn("_at", F.xxhash64("doc_id")).orderBy("_at", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def read(batches):
        seen = Crc()
        for batch in batches:
            blobs = [np.unique(features(x, seen)).tobytes() for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("_at"), pa.array(blobs, pa.binary())], names=["doc_id", "toxic", "_at", "x"])

    def learn(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("_at").to_pylist(), batch.column("toxic").to_pylist(), batch.column("x").to_pylist())
        rows.sort()
        at, w, bias = fit([(np.frombuffer(x, np.int32), int(y > 0)) for _, y, x in rows]) if rows else (np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["at", "w", "bias"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = texts.mapInArrow(read, f"doc_id {kind}, toxic int, _at long, x binary")
    model = hashed.repartition(1).mapInArrow(learn, "at binary, w binary, bias double").collect()
    if not model:
        return np.empty(0, np.int32), np.empty(0, np.float32), 0.0
    return np.frombuffer(model[0]["at"], np.int32), np.frombuffer(model[0]["w"], np.float32), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with `score` appended (an existing column of that name is replaced)."""
    at, w, bias = model
    keep = [c for c in docs.columns if c not in ("score", "text")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", "double")

    def run(batches):
        dense = np.zeros(SPACE, np.float32)
        dense[at] = w
        live = dense != 0
        seen = Crc()
        for batch in batches:
            out = []
            for x in utf8(batch.column("text")):
                f = features(x, seen)
                hit = np.unique(f[live[f]])
                out.append(1 / (1 + np.exp(-np.clip(float(dense[hit].sum(dtype=np.float64)) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(column) -> "F.Column":
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def query(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    model = train(docs, labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))), sample)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
