"""Whitening of embeddings with eigenvectors refined in mixed precision.

The covariance is summed over partitions. Its eigenvectors are first taken in float32; iterations of matrix products in extended
precision (Ogita and Aishima) then correct them, converging quadratically where eigenvalues are apart. Eigenvalues too close
to be told apart form a cluster: there the iteration only restores orthogonality, and a small eigenproblem of
the matrix projected on the cluster, taken about the cluster's mean, turns its basis into eigenvectors.
Only tables of dimension by dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import give_back, table

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Whole numbers up to here fit the sums below; a row with a larger entry has no x-vector.
LARGEST = 2.0**52
FINE = np.longdouble
ROUNDS = 12


def x_vectors(vectors: DataFrame, value: str = "embedding") -> DataFrame:
    """Rows whose vector is whole, with ``x``: floor(1024 c) + 100000 of each entry.

    Left out: null vectors, empty ones, those with a null or non-finite entry or one of 2^52 / 1024 or more, and those of another length than most
    rows have (of equally frequent lengths the largest counts).
    """
    c = F.col(value).cast("array<double>")
    whole = vectors.withColumn(value, c).filter(
        (F.size(value) > 0) & F.forall(value, lambda e: F.coalesce(F.abs(e) < LARGEST / SCALE, F.lit(False)))
    )
    sizes = whole.groupBy(F.size(value).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes:
        whole = whole.filter(F.size(value) == sizes["size"])
    return whole.withColumn("x", F.transform(value, lambda e: F.floor(F.when(F.abs(e) < LARGEST / SCALE, e) * SCALE) + SHIFT))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _totals(x: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension, from one row of decimals per dimension."""
    rows = x.select(F.posexplode(column).alias("i", "e")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [])


def _scatter(x: DataFrame, centre: np.ndarray, project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products and sum of the centred (and, with ``project``, projected) rows, added up by dimension over all partitions."""
    whole = np.floor(centre).astype(np.int64)
    part = (centre - whole).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = (_matrix(batch.column("x"), np.int64) - whole).astype(np.float64) - part
            y = y if project is None else y @ project
            outer, total = (y.T @ y).astype(FINE), y.sum(axis=0).astype(FINE)
            second, first = (outer, total) if second is None else (second + outer, first + total)
        if second is not None:
            high = second.astype(np.float64)
            rest = (second - high).astype(np.float64)
            yield pa.RecordBatch.from_pylist(
                [{"i": i, "row": [*high[i], *rest[i], float(first[i])]} for i in range(len(high))], pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
            )
        give_back()

    parts = x.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r.i for r in cells), default=-1) + 1
    flat = np.zeros((size, 2 * size + 1), FINE)
    for r in cells:
        flat[r.i, r.j] = r.v
    second = flat[:, :size] + flat[:, size : 2 * size]
    return (second + second.T) / 2, flat[:, 2 * size]


def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of eigenvalues (ascending) that follow each other at most ``width`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return np.split(order, cuts)


def _step(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of all eigenvectors: better vectors, eigenvalues, and the distance below which two count as one."""
    eye = np.eye(len(v), dtype=FINE)
    r = eye - x.T @ x
    s = x.T @ (v @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    width = 2 * float(np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(v.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, width


def _split_clusters(v: np.ndarray, x: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """Inside each cluster: the matrix about the cluster's mean, projected on its vectors, scaled to full size and solved."""
    x = x.copy()
    for places in clusters(values, width):
        if len(places) < 2:
            continue
        basis = x[:, places]
        mean = values[places].mean()
        small = basis.T @ (v @ basis) - mean * (basis.T @ basis)
        small = (small + small.T) / 2
        largest = np.abs(small).max()
        if largest > 0:
            _, turn = np.linalg.eigh((small / largest).astype(np.float64))
            x[:, places] = basis @ turn.astype(FINE)
    return x


def refined_eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, from float32 ones corrected in extended precision."""
    v = v.astype(FINE)
    scale = np.abs(v).max()
    if not scale > 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / scale
    _, rough = np.linalg.eigh(a.astype(np.float32))
    x = rough.astype(FINE)
    last = np.inf
    for _ in range(ROUNDS):
        x, values, width = _step(a, x)
        _, values, width = _step(a, x)
        if len(clusters(values, width)) < len(v):
            x = _split_clusters(a, x, values, width)
        if width <= 1e-17 * len(v) or width > last / 2 and width < 1e-14:
            break
        last = width
    x, values, _ = _step(a, x)
    x = x + x @ (np.eye(len(x), dtype=FINE) - x.T @ x) / 2
    x /= np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x) * scale
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([FINE(s // self.n) + FINE(s % self.n) / self.n for s in self.sums], FINE)


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``x`` (see x_vectors); None without rows. Components without variance are left out."""
    n, sums = _totals(x, "x")
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    second, first = _scatter(x, model.mean)
    v = second / n - np.outer(first / n, first / n)
    values, vectors = refined_eigenvectors(v)
    trace = float(np.trace(v))
    live = [i for i in range(min(components, len(values))) if values[i] > 1e-13 * trace]
    values, vectors = values[live], vectors[:, live]
    if not live:
        return Whitening(n, sums, values, vectors, values, 0.0)
    project = vectors / np.sqrt(values)
    w2, w1 = _scatter(x, model.mean, project)
    error = np.abs(w2 / n - np.outer(w1 / n, w1 / n) - np.eye(len(live))).max()
    return Whitening(n, sums, values, vectors, values / trace, float(error))


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum of squares of n x - S over the dimensions, exact; null where it does not fit 64 bits."""
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    y = F.zip_with(x, total, lambda e, s: (e.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(19,0)"))
    return F.aggregate(y, F.lit(0).cast("decimal(38,0)"), lambda acc, e: (acc + e * e).cast("decimal(38,0)")).try_cast("long")


def whiten(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: the key, component, n, deviation, whitened, explained, identity_error.

    Which vectors count is told by x_vectors. Repeated and null keys are rows like others. Directions without variance have no
    component, so equal vectors or a single one give no rows, as does an empty table. Other columns are not read.
    """
    x = x_vectors(vectors.select(F.col(key).alias("vec_id"), F.col(value).alias("embedding"))).select("vec_id", "x")
    model = fit(x, components)
    schema = "vec_id long, n long, deviation long, component int, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = model.n, model.sums
    floors = np.array([s // n for s in sums], np.int64)
    part = (model.mean - floors).astype(np.float64)
    project = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch.column("x"), np.int64) - floors).astype(np.float64) - part
                w = y @ project
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("deviation"), rows], ["vec_id", "deviation", "w"])
        give_back()

    projected = x.withColumn("deviation", deviation(F.col("x"), n, sums)).mapInArrow(run, "vec_id long, deviation long, w array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
