"""Hashed word features of whole texts, and the bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, ragged, text_slices

DIM_BITS = 16
DIM = 1 << DIM_BITS
SAMPLE_ROWS = 5000
WORD_CACHE = 1 << 17


class WordFeatures(dict):
    """Word -> row of the table of its feature numbers: the word, its first four and its last three letters."""

    def __init__(self) -> None:
        self.codes = np.empty((WORD_CACHE, 3), np.int32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        at = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) & (DIM - 1)
        self.codes[n] = at(word), at("^" + word[:4]), at("$" + word[-3:])
        self[word] = n
        return n


def features(texts: list[str | None], cache: WordFeatures) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature numbers, values, word counts) of a list of texts. A value is 1 + log(count) over the root of the text's distinct features."""
    counts = np.zeros(len(texts), np.int64)
    found = [np.empty(0, np.int64)]
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        counts[i] = len(words)
        if not words:
            continue
        if len(cache) + len(words) > WORD_CACHE:
            cache.clear()
        if len(words) > WORD_CACHE:  # a text with more words than the table has rows goes through it in pieces
            codes = []
            for k in range(0, len(words), WORD_CACHE):
                cache.clear()
                codes.append(cache.codes[np.fromiter(map(cache.__getitem__, words[k : k + WORD_CACHE]), np.int64)].ravel())
            codes = np.concatenate(codes)
        else:
            codes = cache.codes[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))].ravel()
        found.append(codes.astype(np.int64) + (i << DIM_BITS))
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    rows = keys >> DIM_BITS
    size = np.bincount(rows, minlength=len(texts))
    offsets = np.concatenate(([0], np.cumsum(size)))
    values = (1 + np.log(times)) / np.sqrt(size[rows])
    return offsets, (keys & (DIM - 1)).astype(np.int32), values.astype(np.float32), counts


def dots(offsets: np.ndarray, index: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The product of each sparse row with ``weights`` (DIM, or DIM x k)."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if weights.ndim == 1:
        return np.bincount(rows, weights[index] * values, len(offsets) - 1)
    return np.stack([np.bincount(rows, weights[index, k] * values, len(offsets) - 1) for k in range(weights.shape[1])], 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordFeatures()
    for batch in batches:
        for piece in text_slices(batch, "text"):
            offsets, index, values, _ = features(piece.column("text").to_pylist(), cache)
            yield pa.record_batch({"target": piece.column("target"), "index": ragged(offsets, index, pa.int32()), "value": ragged(offsets, values, pa.float32())})
    del cache
    give_back()


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, rows: int = SAMPLE_ROWS, seed: int = 1, fold: int | None = None) -> DataFrame:
    """(target, index, value) of at most ``rows`` labelled documents, those with the smallest hash of the id. Labels without a document take no place.

    ``target`` is an int column over ``labels``; rows where it or the id is null are left out. ``fold`` 0 or 1 takes only
    ids with an even or an odd hash, to try a model on rows it has not seen. The sample has a fixed bound, so its broadcast has one too.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), target.cast("int").alias("target"), h.alias("h"))
    wanted = wanted.filter("doc_id is not null and target is not null").distinct()
    if fold is not None:
        wanted = wanted.filter(F.pmod("h", F.lit(2)) == fold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = wanted.join(texts.select("doc_id"), "doc_id", "left_semi")
    wanted = wanted.orderBy("h", "target").limit(rows).select("doc_id", "target")
    return texts.join(F.broadcast(wanted), "doc_id").select("target", "text").mapInArrow(_extract, "target int, index array<int>, value array<float>")


def sparse_rows(frame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, offsets, index, values) of a pandas frame of the sample, in a fixed order."""
    frame = frame.iloc[np.argsort([zlib.crc32(np.asarray(x).tobytes()) for x in frame["index"]], kind="stable")]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in frame["index"]]))).astype(np.int64)
    index = np.concatenate([np.asarray(x, np.int64) for x in frame["index"]] or [np.empty(0, np.int64)])
    values = np.concatenate([np.asarray(x, np.float64) for x in frame["value"]] or [np.empty(0)])
    return frame["target"].to_numpy(np.int64), offsets, index, values


def curvature(rows: np.ndarray, index: np.ndarray, values: np.ndarray, weight: np.ndarray) -> float:
    """Largest eigenvalue of sum_i weight_i x_i x_i', by power iteration; bounds the step of a gradient descent."""
    v = np.bincount(index, values, DIM)
    size = 1.0
    for _ in range(12):
        v = np.bincount(index, (weight * np.bincount(rows, v[index] * values, len(weight)))[rows] * values, DIM)
        size = float(np.linalg.norm(v))
        if size == 0:
            return 1.0
        v = v / size
    return size
