"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that a text has (not how often). Each feature's value is its log-count ratio
between the labelled classes, and a logistic regression weighs these values. The fit uses a bounded sample of labelled
rows (SAMPLE, by hash of the id) and the FEATURES most telling n-grams; scoring covers every row and whole texts.

Defined results: null and empty texts get the score of the intercept; without labels of both classes every score is the
share of label 1 (0 without labels); rows are scored alone, so repeated rows and ties don't matter; a document labelled
several times counts as toxic if any label says so; very long texts are one slice of their own; an empty table gives an
empty one; columns besides doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .ngrams import hashes, lower_visible, spaced

ORDERS = (3, 4, 5)
BITS = 20
#: Labelled rows that the classifier is fitted on, about; n-grams that it uses.
SAMPLE, FEATURES = 20_000, 3000
ROUNDS, PENALTY = 150, 1e-4


@dataclass
class Classifier:
    weights: np.ndarray  # of each hashed n-gram
    intercept: float


def _present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the n-grams each text has, each once; only wanted features if given."""
    points, row, _ = spaced(column, lower_visible())
    keys = []
    for n in ORDERS:
        h, inside = hashes(points, n)
        feature = (h >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            inside = inside & wanted[feature]
        keys.append((row[: len(h)][inside].astype(np.int64) << BITS) | feature[inside])
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from (doc_id, text) and (doc_id, toxic)."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    u = F.xxhash64("doc_id", F.lit(9)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = F.broadcast(labels.filter(u < min(1.0, sample / max(1, n))))  # about `sample` pairs of numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int64)
        sizes = np.zeros(2, np.int64)
        for batch in chunks(batches, "text", 1 << 21):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            row, feature = _present(batch.column("text"))
            for k in (0, 1):
                totals[k] += np.bincount(feature[toxic[np.minimum(row, len(toxic) - 1)] == bool(k)], minlength=1 << BITS)
                sizes[k] += np.count_nonzero(toxic == bool(k))
        at = np.flatnonzero(totals.sum(0))
        out = [np.append(at, -1), np.append(totals[0][at], sizes[0]), np.append(totals[1][at], sizes[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["feature", "clean", "toxic"])

    found = rows.mapInArrow(count, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    sizes = found[found.feature == -1]
    clean, toxic = (int(sizes[c].sum()) for c in ("clean", "toxic"))
    base = toxic / max(1, clean + toxic)
    weights = np.zeros(1 << BITS, np.float32)
    if not clean or not toxic:
        return Classifier(weights, float(np.log(max(base, 1e-9) / max(1 - base, 1e-9))))
    found = found[(found.feature >= 0) & (found.clean + found.toxic >= 3)].sort_values("feature")
    p, q = (found.toxic.to_numpy() + 0.5) / (toxic + 1.0), (found.clean.to_numpy() + 0.5) / (clean + 1.0)
    ratio = np.log(p / q)
    spread = (p * (1 - p)).clip(1e-9) / toxic + (q * (1 - q)).clip(1e-9) / clean
    telling = np.abs(p - q) / np.sqrt(spread)
    top = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    features, ratio = found.feature.to_numpy()[top], ratio[top]
    wanted = np.zeros(1 << BITS, bool)
    wanted[features] = True
    place = np.zeros(1 << BITS, np.int32)
    place[features] = np.arange(len(features))

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            row, feature = _present(batch.column("text"), wanted)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(cut), pa.array(place[feature]))], names=["toxic", "features"])

    table = rows.mapInArrow(rare, "toxic int, features array<int>").toArrow()  # bounded by the sample
    y = (table.column("toxic").to_numpy() > 0).astype(float)
    lists = table.column("features").combine_chunks()
    col = np.concatenate([x.values.to_numpy() for x in (lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists])])
    size = np.array(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    w, b = _logistic(np.repeat(np.arange(len(y)), size), col, ratio, y)
    weights[features] = w * ratio
    return Classifier(weights, b)


def _logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Adam on all rows; the feature in column c has value[c] where present."""
    n, m = len(y), len(value)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, ROUNDS + 1):
        margin = np.bincount(row, weights=(w * value)[col], minlength=n) + b
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        grad = np.append(np.bincount(col, weights=err[row], minlength=m) * value + PENALTY * w, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score (the probability of label 1) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = model.weights != 0
        for batch in chunks(batches, "text"):
            row, feature = _present(batch.column("text"), wanted)
            margin = np.bincount(row, weights=model.weights[feature], minlength=batch.num_rows) + model.intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
