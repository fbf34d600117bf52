"""Quality by ordinal regression: one weight vector over hashed words, ordered thresholds between grades.

P(grade > j) = sigmoid(w . x - t_j) with t_0 < t_1 < ... The thresholds are a first value and the exponentials of
free steps, so they stay ordered. The model is fitted on a bounded sample of labelled documents (``sample_rows``) in one
task and then scores every whole text in Arrow batches; nothing but the model passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, text_slices
from dossier.llm.hashed_text import DIM, SAMPLE_ROWS, WordFeatures, curvature, dots, features, labelled_sample, sparse_rows

STEPS = 150
RIDGE = 1e-5
KEEP_TAIL = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: list[str | None], cache: WordFeatures) -> np.ndarray:
        """P(grade > j) for each text and j."""
        offsets, index, values, _ = features(texts, cache)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - dots(offsets, index, values, self.weights)[:, None], -60, 60)))


def graded(labels: DataFrame) -> Column:
    """Grade 0 toxic, 1 poor, 2 good, from the two binary ratings; null where a rating is missing."""
    return F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def fit_rows(y: np.ndarray, offsets: np.ndarray, index: np.ndarray, values: np.ndarray, grades: int) -> OrdinalModel:
    """Penalised likelihood by accelerated gradient descent; a grade weighs as the root of its share."""
    if not len(y):
        return OrdinalModel(np.zeros(DIM), -np.linspace(grades + 4.0, 6.0, grades - 1))
    n, m = len(y), grades - 1
    share = np.bincount(y, minlength=grades) / n
    above = np.clip(1 - np.cumsum(share)[:-1], 0.02, 0.98)
    start = np.maximum.accumulate(np.log(1 - above) - np.log(above)) + 0.01 * np.arange(m)
    w, b = np.zeros(DIM), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    weight = (1 / np.sqrt(np.maximum(share, 1e-9)))[y]
    weight /= weight.sum()
    rows = np.repeat(np.arange(n), np.diff(offsets))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    pace, turn, k = 3.5 / curvature(rows, index, values, weight), 0, np.arange(n)
    last_w, last_b, best = w, b, (np.inf, w, b)
    for _ in range(STEPS):
        ahead = turn / (turn + 3)
        at_w, at_b, last_w, last_b, turn = w + ahead * (w - last_w), b + ahead * (b - last_b), w, b, turn + 1
        cuts = at_b[0] + np.concatenate(([0.0], np.cumsum(np.exp(at_b[1:]))))
        z = np.bincount(rows, at_w[index] * values, n)
        tail = np.concatenate((np.ones((n, 1)), sigmoid(z[:, None] - cuts), np.zeros((n, 1))), 1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[k, y] - tail[k, y + 1], 1e-12)
        loss = float(-(weight * np.log(p)).sum() + 0.5 * RIDGE * (at_w @ at_w))
        if loss > 1.05 * best[0]:  # too far: back to the best point with half the step
            pace, turn = pace / 2, 0
            w, b = last_w, last_b = best[1:]
            continue
        if loss < best[0]:
            best = (loss, at_w, at_b)
        else:
            turn = 0
        up, down = weight * slope[k, y] / p, weight * slope[k, y + 1] / p
        gc = np.zeros(m)
        np.add.at(gc, y[y > 0] - 1, up[y > 0])
        np.subtract.at(gc, y[y < m], down[y < m])
        w = at_w - pace * (np.bincount(index, (down - up)[rows] * values, DIM) + RIDGE * at_w)
        b = at_b - min(pace, 1.0) * np.concatenate(([gc.sum()], [gc[j:].sum() * np.exp(at_b[j]) for j in range(1, m)]))
    _, w, b = best
    return OrdinalModel(w, b[0] + np.concatenate(([0.0], np.cumsum(np.exp(b[1:])))))


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, grades: int = 3, sample_rows: int = SAMPLE_ROWS, fold: int | None = None) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents; without any, the model finds every text good."""
    sample = labelled_sample(docs, labels, graded(labels) if grade is None else grade, sample_rows, fold=fold)

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            model = fit_rows(*sparse_rows(pd.concat(held)), grades)
            del held
            give_back()
            yield pd.DataFrame({"weights": [model.weights.tobytes()], "cuts": [model.cuts.tobytes()]})

    got = sample.repartition(1).mapInPandas(one, "weights binary, cuts binary").first()
    if got is None:
        return fit_rows(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), grades)
    return OrdinalModel(np.frombuffer(got["weights"]), np.frombuffer(got["cuts"]))


def score(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """Columns doc_id, grade (expected), p_above_0 .. p_above_k, kept, one row per row of ``docs``.

    ``kept`` holds where the highest tail probability reaches ``keep_tail``. Null and empty texts have no
    features and get the thresholds' own probabilities; repeated rows score alike; an empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    m = len(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for batch in batches:
            for piece in text_slices(batch, "text"):
                tails = send.value.tails(piece.column("text").to_pylist(), cache)
                out = {"doc_id": piece.column("doc_id"), "grade": tails.sum(1)} | {f"p_above_{j}": tails[:, j] for j in range(m)}
                yield pa.record_batch(out | {"kept": tails[:, -1] >= keep_tail})
        del cache
        give_back()

    schema = "doc_id long, grade double, " + ", ".join(f"p_above_{j} double" for j in range(m)) + ", kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns; the decision is the one of ``score``."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for batch in batches:
            for piece in text_slices(batch, "text"):
                yield piece.filter(pa.array(send.value.tails(piece.column("text").to_pylist(), cache)[:, -1] >= keep_tail))
        del cache
        give_back()

    return docs.mapInArrow(run, docs.schema)
