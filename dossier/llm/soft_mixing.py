"""Mixing to target weights with soft domain membership.

A softmax regression fitted on the labelled table gives each document posteriors p_d over the domains. Document rates
r >= 0 are then fitted so that the expected domain totals sum_i r_i n_i p_id (n_i tokens) match the targets, by projected
gradient on the least-squares distance, r <- clip(r - p . g). The metric is the inverse of sum_i n_i p_i p_i' over the rows
that are free to move, so a few steps suffice. A step needs one aggregate over the written posteriors, whose result is a
few numbers per domain; a rate is recomputed from the short list of gradients, so no rate table is rewritten between steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, probably_in, text_slices
from dossier.llm.hashed_text import DIM, SAMPLE_ROWS, WordFeatures, curvature, dots, features, labelled_sample, sparse_rows
from dossier.session import stage

DOMAINS = ("clean", "poor", "toxic")
WEIGHTS = (0.85, 0.10, 0.05)
FACTORS = (1.0, 0.5, 0.25)
STEPS = 40
TOLERANCE = 1e-6
FIT_STEPS = 100
RIDGE = 1e-5


@dataclass(frozen=True)
class DomainModel:
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[str | None], cache: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
        """(word counts, posterior of each domain) of each text."""
        offsets, index, values, counts = features(texts, cache)
        z = dots(offsets, index, values, self.weights) + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return counts, p / p.sum(axis=1, keepdims=True)


def domain_of(labels: DataFrame) -> Column:
    """Number of the domain in DOMAINS of a labelled row; null where a rating is missing."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def fit_rows(y: np.ndarray, offsets: np.ndarray, index: np.ndarray, values: np.ndarray, domains: int) -> DomainModel:
    """Softmax regression by accelerated gradient descent on the penalised likelihood."""
    n = len(y)
    w, b = np.zeros((DIM, domains)), np.zeros(domains)
    if not n:
        return DomainModel(w, b)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    b = np.log((np.bincount(y, minlength=domains) + 1) / (n + domains))
    want = np.eye(domains)[y]
    pace = 1.8 / curvature(rows, index, values, np.full(n, 1 / n))
    last_w, last_b = w, b
    for step in range(1, FIT_STEPS + 1):
        ahead = (step - 1) / (step + 2)
        at_w, at_b, last_w, last_b = w + ahead * (w - last_w), b + ahead * (b - last_b), w, b
        z = np.stack([np.bincount(rows, at_w[index, k] * values, n) for k in range(domains)], 1) + at_b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - want) / n
        w = at_w - pace * (np.stack([np.bincount(index, d[rows, k] * values, DIM) for k in range(domains)], 1) + RIDGE * at_w)
        b = at_b - d.sum(0)
    return DomainModel(w, b)


def fit(docs: DataFrame, labels: DataFrame, domain: Column | None = None, domains: int = len(DOMAINS), sample_rows: int = SAMPLE_ROWS, fold: int | None = None) -> DomainModel:
    """Fit on at most ``sample_rows`` labelled documents; without any, all domains are equally likely."""
    sample = labelled_sample(docs, labels, domain_of(labels) if domain is None else domain, sample_rows, fold=fold)

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            model = fit_rows(*sparse_rows(pd.concat(held)), domains)
            del held
            give_back()
            yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()]})

    got = sample.repartition(1).mapInPandas(one, "weights binary, bias binary").first()
    if got is None:
        return DomainModel(np.zeros((DIM, domains)), np.zeros(domains))
    return DomainModel(np.frombuffer(got["weights"]).reshape(DIM, domains), np.frombuffer(got["bias"]))


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, th (hash of the text), n_tokens (words) and p (array of domain posteriors), one row per row."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for batch in batches:
            for piece in text_slices(batch, "text"):
                counts, p = send.value.posteriors(piece.column("text").to_pylist(), cache)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "th": piece.column("th"), "n_tokens": counts, "p": flat})
        del cache
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, th long, n_tokens long, p array<double>")


def rate_of(gradients: Sequence[Sequence[float]], domains: int) -> Column:
    """The rate that the projected steps give a row with posteriors ``p``."""
    if not len(gradients):
        return F.lit(1.0)
    steps = F.array(*[F.struct(*[F.lit(float(g)).alias(f"g{k}") for k, g in enumerate(step)]) for step in gradients])

    def move(r: Column, s: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum((F.get("p", F.lit(k)) * s[f"g{k}"] for k in range(domains)), F.lit(0.0)))

    return F.aggregate(steps, F.lit(1.0), move)


@dataclass(frozen=True)
class Mix:
    gradients: tuple[tuple[float, ...], ...]
    target: tuple[float, ...]
    reached: tuple[float, ...]


def fit_rates(table: DataFrame, weights: Sequence[float], total: float | None = None, steps: int = STEPS) -> Mix:
    """Projected gradient over the written posteriors. ``weights`` are the wanted shares of ``total`` expected tokens, by default of all."""
    k = len(weights)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens").cast("double")

    def totals(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected domain totals, and sum n p p' over the rows with a positive rate."""
        got = table.select("n_tokens", "p", rate.alias("r")).agg(
            *[F.coalesce(F.sum(F.col("r") * n * p[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k)],
            *[F.coalesce(F.sum(F.when(F.col("r") > 0, n * p[i] * p[j])), F.lit(0.0)).alias(f"a{i}_{j}") for i in range(k) for j in range(k)],
            *[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"b{i}_{j}") for i in range(k) for j in range(k)],
        ).first()
        grid = lambda x: np.array([[got[f"{x}{i}_{j}"] for j in range(k)] for i in range(k)])
        return np.array([got[f"t{i}"] for i in range(k)]), grid("a") + 0.05 * grid("b")

    now, gram = totals(F.lit(1.0))
    share = np.asarray(weights, float) / np.sum(weights)
    target = share * (now.sum() if total is None else total)
    gradients: list[tuple[float, ...]] = []
    best = (np.inf, 0, now)
    while now.sum() > 0 or gradients:
        off = now - target
        size = float(np.abs(off).sum() / max(np.abs(target).sum(), 1e-9))
        if size < best[0]:
            best = (size, len(gradients), now)
        if size < TOLERANCE or len(gradients) == steps:
            break
        gradients.append(tuple(float(x) for x in np.linalg.pinv(gram) @ off))
        now, gram = totals(rate_of(gradients, k))
    return Mix(tuple(gradients[: best[1]]), tuple(target), tuple(float(x) for x in best[2]))


def mix(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies for every row of ``docs``.

    ``copies`` is the rate's whole part plus one with the probability of its fraction, by a hash of id and text, so the same
    row always gets the same number. Null and wordless texts have no tokens and the prior's posteriors, and get a rate
    like any row. Repeated rows get equal rates; an empty table gives no rows; other columns are ignored.
    """
    table = stage(posteriors(docs, fit(docs, labels)))
    fitted = fit_rates(table, weights)
    return decide(table, fitted, seed).select("doc_id", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", "copies")


def _draw(seed: int) -> Column:
    """A number in [0, 1) from id and text."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), "doc_id", "th"), F.lit(11)) / F.lit(float(1 << 53))


def decide(table: DataFrame, fitted: Mix, seed: int) -> DataFrame:
    rated = table.withColumn("rate", rate_of(fitted.gradients, len(fitted.target)))
    return rated.withColumn("copies", (F.floor("rate") + (_draw(seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def shares(table: DataFrame, domains: int = len(DOMAINS)) -> tuple[float, ...]:
    """The share of each domain in the expected tokens of written posteriors; zeros without tokens."""
    got = table.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.get("p", F.lit(i))), F.lit(0.0)) for i in range(domains)]).first()
    return tuple(float(x) / (sum(got) or 1.0) for x in got)


def thin(docs: DataFrame, labels: DataFrame, factors: Sequence[float] = FACTORS, seed: int = 11, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` left when each domain's share is scaled by its factor, with all their columns.

    Shares do not change when all rates are divided by one number, so a row stays with the probability of its rate over the mean rate
    of the rows that are mostly of the first domain; those rows always stay, so the shares reached lie above the targets by
    what such rows hold of the other domains (see ``shares``). Rows go by id and text; an empty table gives no rows.
    ``labelled`` has the documents that the model is fitted on, by default ``docs``: pass the whole table when ``docs`` was
    filtered by what the labels say. Null and wordless texts have the prior's posteriors; columns may have any names.
    """
    table = stage(posteriors(docs, fit(docs if labelled is None else labelled, labels)))
    k, n = len(factors), F.col("n_tokens")
    have = table.agg(*[F.coalesce(F.sum(n * F.get("p", F.lit(i))), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
    wanted = [have[f"t{i}"] * f for i, f in enumerate(factors)]
    if sum(wanted) <= 0:
        return docs
    rated = table.withColumn("rate", rate_of(fit_rates(table, wanted).gradients, k))
    main = F.get("p", F.lit(0)) >= 0.5
    full = rated.filter(main).agg(F.sum(n * F.col("rate")) / F.sum(n)).first()[0] or 1.0
    gone = stage(rated.filter(~main & (_draw(seed) >= F.col("rate") / full)).select(F.xxhash64("doc_id", "th").alias("key"), "doc_id", "th").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    found = probably_in(rows, F.xxhash64("doc_id", "th"), gone.select("key"), mark="maybe")
    away = gone.select(F.col("doc_id").alias("id"), F.col("th").alias("hash"))
    same = F.col("th").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return found.filter("not maybe").select("row.*").union(found.filter("maybe").join(away, same, "left_anti").select("row.*"))
