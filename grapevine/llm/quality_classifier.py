"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

The model is fitted on about ``SAMPLE`` labelled documents at most, drawn by a hash of their id, in one
task. Rows that repeat an id are one document, the one whose text is least; scoring is a sparse dot product per document and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W
from grapevine.llm.rows import in_arrow, with_columns

BITS = 18
SAMPLE = 8000  # labelled documents that the model is fitted on, in expectation
THRESHOLD = 0.7
_TWICE = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Leader:
    """Settings of the update: learning rate, its smoothing, both penalties, and rounds over the sample."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    rounds: int = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in a row, and where each text's begin; a null has none.

    Words are runs of letters and digits, and runs of other signs. There is a bucket for each
    word, for each two neighbours, and one for a word that stands twice in a row.
    """
    text = W.text_of(texts)
    begin, _, hashes = W.hashed_words(text, _words)
    bounds = W.word_counts(text, begin)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    left, right = hashes[pairs], hashes[pairs + 1]
    joined = W.mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)
    twice = pairs[left == right]
    every = np.concatenate([hashes, joined, np.full(len(twice), _TWICE)])
    owner = np.concatenate([rows, rows[pairs], rows[twice]])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(bounds) - 1)
    return (every[order] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def _words(text: W.Text) -> tuple[np.ndarray, np.ndarray]:
    return W.words_of(text, W.LETTERS_APART)


def train(examples: Iterator[tuple[int, np.ndarray, np.ndarray]], settings: Leader) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the constant, from (label, buckets, values) of each example."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = [
        (label, np.append(buckets, size), np.append(values, 1.0)) for label, buckets, values in examples
    ]

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    for _ in range(settings.rounds):
        for label, at, values in examples:
            w = weights(at)
            gradient = (_logistic(w @ values) - label) * values
            more = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(more) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = more
    w = weights(slice(None))
    return w[:size], float(w[size])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    constant: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        buckets, bounds = features(texts)
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        dots = np.bincount(rows, self.weights[buckets], len(bounds) - 1)
        return _logistic(dots / np.sqrt(np.maximum(np.diff(bounds), 1)) + self.constant)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Leader | None = None) -> Model:
    """The model of the labelled documents for which ``learn`` (over ``doc_id``) holds.

    A document with labels that contradict each other teaches nothing; without any labelled
    document every score is one half. Only the ids, labels and texts of the sample move; of rows with
    the same id, however many, the one whose text is least (in byte order; a null is empty) teaches.
    """
    settings = settings or Leader()
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
    )
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = min(1.0, SAMPLE / max(1, known.count()))
    sample = known.where(drawn < int(share * (1 << 30))).select("doc_id", "quality", drawn.alias("turn"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about SAMPLE short rows
    # Each task keeps a row of an id, so one with very many rows is as many rows as tasks.
    texts = rows.groupBy("doc_id", "quality", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", W.BLOCK):
            buckets, bounds = features(block.column("text"))
            found = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:], strict=False)]
            rows = {
                "at": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                "times": pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays(
                [block.column("quality"), block.column("turn"), *rows.values()], names=["quality", "turn", *rows]
            )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples():
            for batch in batches:
                for label, at, times in zip(*[batch.column(c) for c in ("quality", "at", "times")], strict=True):
                    counts = times.values.to_numpy()
                    yield label.as_py(), at.values.to_numpy(), counts / np.sqrt(max(1, counts.sum()))

        weights, constant = train(examples(), settings)
        used = np.flatnonzero(weights)
        at, values = np.append(used, -1), np.append(weights[used], constant)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values)], names=["at", "weight"])

    kind = labels.schema["quality"].dataType.simpleString()
    counted = in_arrow(texts, sparse, f"quality {kind}, turn long, at array<int>, times array<int>")
    in_turn = counted.repartition(1).sortWithinPartitions("turn", "quality", "at")
    trained = in_arrow(in_turn, learned, "at long, weight double").toArrow()  # at most a number per bucket
    at, values = trained["at"].to_numpy(), trained["weight"].to_numpy()
    model = Model(np.zeros(1 << BITS), float(values[at < 0].sum()))
    model.weights[at[at >= 0]] = values[at >= 0]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns and ``score`` (0 to 1) of every document; a null text scores as an empty one.

    A column named ``score`` would clash: rename it, or use ``accepted``.
    """
    return with_columns(docs, "text", "score double", lambda texts: {"score": model.scores(texts)}, W.BLOCK)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold or more, with all their columns. Rows that repeat stay or go together.

    A text is handed to Python once, not also within the whole row.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    row = F.struct(*others or [F.lit(0)]).alias("_row")
    kept = scored(docs.select(row, "text"), model).where(F.col("score") >= threshold)
    return kept.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
