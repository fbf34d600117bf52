"""Nearest-neighbour search, result ranks, vector store maintenance.

Search never pairs rows in a join and copies no row of either side. The queries are written once and cut into slices of bounded
bytes; a slice travels to the tasks as one matrix, every task multiplies its Arrow batches with it and keeps k rows per query. More
queries mean more slices, one narrow scan each, never a larger slice: the driver holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.vectors import sign_code
from dossier.operators.scans import prefix_scan
from dossier.session import stage

QUERY_BYTES = 64 << 20
DECIMALS = 6
# Distance tiles: rows x queries (squared L2 also holds the dimension).
ROW_TILE = 4096
QUERY_TILE = 512
L2_QUERY_TILE = 8


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """len(q) x len(x), rounded so that every engine ranks alike. A zero vector has cosine distance 1 to all."""
    if metric == "cosine":
        size = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
        d = 1.0 - np.divide(q @ x.T, size, out=np.zeros_like(size), where=size != 0)
    else:
        d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2)
    return np.round(d, DECIMALS)


def _keep_best(best: list, ids: np.ndarray, dist: np.ndarray, k: int) -> None:
    """Merge one batch into the per-query (distance, id) lists."""
    for i, row in enumerate(dist):
        ok = np.flatnonzero(np.isfinite(row))
        if len(ok) > k:
            cut = np.partition(row[ok], k - 1)[k - 1]
            ok = ok[row[ok] <= cut]
        d0, i0 = best[i]
        d, n = np.concatenate([d0, row[ok]]), np.concatenate([i0, ids[ok]])
        order = np.lexsort((n, d))[:k]
        best[i] = (d[order], n[order])


def _empty(n: int) -> list:
    return [(np.empty(0), np.empty(0, dtype="int64")) for _ in range(n)]


def _scan_batch(best, batch, qids, q, metric, k, exclude_self=False, qcodes=None, radius=0) -> None:
    """Distances of one Arrow batch to all queries, in tiles that keep the matrix small."""
    rows, width = ROW_TILE, QUERY_TILE if metric == "cosine" else L2_QUERY_TILE
    for at in range(0, len(batch), rows):
        part = batch.iloc[at : at + rows]
        ids = part["id"].to_numpy("int64")
        x = np.stack(part["embedding"]).astype("float64")
        for lo in range(0, len(qids), width):
            hi = min(lo + width, len(qids))
            dist = _distances(x, q[lo:hi], metric)
            if qcodes is not None:
                flips = np.bitwise_count(qcodes[lo:hi, None] ^ part["code"].to_numpy("int64")[None, :])
                dist = np.where(flips <= radius, dist, np.inf)
            if exclude_self:
                dist = np.where(qids[lo:hi, None] == ids[None, :], np.inf, dist)
            tile = best[lo:hi]
            _keep_best(tile, ids, dist, k)
            best[lo:hi] = tile


def _emit(qids, best) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "qid": np.repeat(qids, [len(d) for d, _ in best]),
            "id": np.concatenate([n for _, n in best]) if best else np.empty(0, dtype="int64"),
            "distance": np.concatenate([d for d, _ in best]) if best else np.empty(0),
        }
    )


def _search_slice(vectors: DataFrame, queries: DataFrame, k: int, metric: str, where: bool, exclude_self: bool) -> DataFrame:
    """Every vector against one slice of queries. With ``where``, vectors of chapters that no query names are not read, and a
    vector meets only the queries of its own chapter."""
    rows = queries.select("qid", "embedding", *(["where"] if where else [])).toPandas()
    if rows.empty:
        return vectors.sparkSession.createDataFrame([], "qid long, id long, distance double")
    groups: dict = {}
    if where:
        rows = rows[rows["where"].notna()].reset_index(drop=True)
        groups = {w: np.asarray(at) for w, at in rows.groupby("where").indices.items()}
        if not groups:
            return vectors.sparkSession.createDataFrame([], "qid long, id long, distance double")
    payload = vectors.sparkSession.sparkContext.broadcast((rows["qid"].to_numpy("int64"), np.stack(rows["embedding"]).astype("float64"), groups))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, groups = payload.value
        best = _empty(len(qids))
        for batch in batches:
            if not where:
                _scan_batch(best, batch, qids, q, metric, k, exclude_self)
                continue
            for chapter, part in batch.groupby("chapter"):
                at = groups.get(chapter, np.empty(0, np.int64))
                mine = [best[i] for i in at]
                _scan_batch(mine, part, qids[at], q[at], metric, k, exclude_self)
                for i, found in zip(at, mine):
                    best[i] = found
        yield _emit(qids, best)

    side = vectors.select("id", "embedding", *(["chapter"] if where else []))
    if where:
        side = side.filter(F.col("chapter").isin([w.item() if hasattr(w, "item") else w for w in groups]))
    return side.mapInPandas(scan, "qid long, id long, distance double")


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: bool = False,
    exclude_self: bool = False, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Exact top-k per query: qid, id, distance (6 decimals), rank; ties by id.

    ``vectors``: id, embedding [, chapter]; ``queries``: qid, embedding [, where]. With ``where`` only
    vectors of that chapter compete; a query without one finds nothing. ``metric`` is cosine or l2 (squared). Slices hold
    ``query_bytes`` at most; all but a single one are searched and written before the next is read.
    """
    asked = stage(queries.select("qid", "embedding", *(["where"] if where else [])))
    n_queries, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    slices = max(1, min(n_queries, -(-n_queries * dim * 8 // query_bytes)))
    if slices == 1:
        return top_k(_search_slice(vectors, asked, k, metric, where, exclude_self), k)
    part = F.pmod(F.xxhash64("qid"), F.lit(slices))
    return reduce(DataFrame.union, [stage(top_k(_search_slice(vectors, asked.filter(part == i), k, metric, where, exclude_self), k)) for i in range(slices)])


def top_k(found: DataFrame, k: int, by: str = "qid") -> DataFrame:
    w = Window.partitionBy(by).orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def probes(code: int, bits: int, radius: int) -> list[int]:
    """Codes within ``radius`` bit flips."""
    return [reduce(lambda c, b: c ^ (1 << b), flips, code) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def bucket_vectors(vectors: DataFrame, bits: int) -> DataFrame:
    """Add the sign code; write partitioned by it so a search reads only the probed folders."""
    return vectors.withColumn("code", sign_code(F.col("embedding"), bits))


def bucketed_knn(bucketed: DataFrame, queries: DataFrame, k: int, bits: int, radius: int = 1, metric: str = "cosine") -> DataFrame:
    """Approximate top-k: only vectors whose code is within ``radius`` flips of the query's compete.

    The probed codes are pushed to the scan as a filter, so unprobed partitions are not read. Every
    vector of a probed bucket is looked at whatever its size; nothing is capped. Queries over the byte limit go in
    slices by the hash of their id, one scan each.
    """
    coded = stage(queries.select("qid", "embedding").withColumn("qcode", sign_code(F.col("embedding"), bits)))
    size, dim = coded.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    slices = max(1, min(size, -(-size * dim * 8 // QUERY_BYTES)))
    if slices == 1:
        return top_k(_bucketed_search(bucketed, coded, k, bits, radius, metric), k)
    part = F.pmod(F.xxhash64("qid"), F.lit(slices))
    return reduce(DataFrame.union, [stage(top_k(_bucketed_search(bucketed, coded.filter(part == i), k, bits, radius, metric), k)) for i in range(slices)])


def _bucketed_search(bucketed: DataFrame, coded: DataFrame, k: int, bits: int, radius: int, metric: str) -> DataFrame:
    rows = coded.select("qid", "embedding", "qcode").toPandas()
    if rows.empty:
        return bucketed.sparkSession.createDataFrame([], "qid long, id long, distance double")
    wanted = sorted({p for c in rows["qcode"] for p in probes(int(c), bits, radius)})
    payload = bucketed.sparkSession.sparkContext.broadcast(
        (rows["qid"].to_numpy("int64"), np.stack(rows["embedding"]).astype("float64"), rows["qcode"].to_numpy("int64"))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, qcodes = payload.value
        best = _empty(len(qids))
        for batch in batches:
            _scan_batch(best, batch, qids, q, metric, k, qcodes=qcodes, radius=radius)
        yield _emit(qids, best)

    near = bucketed.filter(F.col("code").isin(wanted)).select("id", "embedding", "code")
    return near.mapInPandas(scan, "qid long, id long, distance double")


def recall_against(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate result holds."""
    hit = exact.select("qid", "id").join(approx.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.count("*").alias("expected"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[pd.Series], list], dim: int) -> DataFrame:
    """Batch-encode text: id, embedding, error. A failing batch yields null vectors and its error; the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                vecs, err = list(encoder(batch["text"])), None
                if any(len(v) != dim for v in vecs):
                    raise ValueError(f"encoder gave another width than {dim}")
            except Exception as exc:  # noqa: BLE001
                vecs, err = [None] * len(batch), f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame({"id": batch["id"], "embedding": vecs, "error": err})

    side = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return side.mapInPandas(run, "id long, embedding array<double>, error string")


def hashed_words(dim: int) -> Callable[[pd.Series], list]:
    """Default encoder: counts of lower-case words hashed into ``dim`` places (no model needed)."""
    import hashlib

    place: dict[str, int] = {}

    def slot(w: str) -> int:
        if w not in place:
            if len(place) > 500_000:
                place.clear()
            place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
        return place[w]

    def encode_batch(texts: pd.Series) -> list:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, slot(w)] += 1.0
        return list(out)

    return encode_batch


def first_ranks(results: DataFrame, queries: DataFrame) -> DataFrame:
    """First rank whose chapter is the expected one, an accepted one, or whose section holds the expected text.

    ``results``: qid, rank, chapter, section. Queries without any result keep null ranks.
    """
    section_hit = F.contains(F.upper(F.col("section")), F.upper(F.col("expected_section")))
    ranked = results.join(queries.select("qid", "expected_chapter", "accepted_chapters", "expected_section"), "qid")
    ranks = ranked.groupBy("qid").agg(
        F.min(F.when(F.col("chapter") == F.col("expected_chapter"), F.col("rank"))).alias("chapter_rank"),
        F.min(F.when(F.array_contains("accepted_chapters", F.col("chapter")), F.col("rank"))).alias("accepted_rank"),
        F.min(F.when(section_hit, F.col("rank"))).alias("section_rank"),
    )
    return queries.drop("embedding").join(ranks, "qid", "left")


def status_label(rank: Column, k: int) -> Column:
    return F.when(rank == 1, "HIT").when(rank <= 3, "TOP3").when(rank <= k, f"TOP{k}").otherwise("MISS")


def align(ids: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned pairs, mismatch report) of vectors and chunks by id."""
    pairs = ids.join(chunks, "chunk_id")
    both = ids.select("chunk_id", F.lit(True).alias("has_vector")).join(
        chunks.select("chunk_id", F.lit(True).alias("has_chunk")), "chunk_id", "full_outer"
    )
    return pairs, both.filter("has_vector is null or has_chunk is null")


def metadata(chunks: DataFrame) -> DataFrame:
    """Flat scalar metadata with defaults; the page range becomes text."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    pages = F.concat(F.lit("["), F.col("page_range.lo"), F.lit(", "), F.col("page_range.hi"), F.lit("]"))
    return chunks.select(
        "chunk_id", s("chapter"), s("section"), s("subsection"), F.coalesce(pages, F.lit("")).alias("page_range"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"), s("chunk_type"), s("source"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows over old ones; inside ``new`` the last write by ``order`` wins. Both keep only one row per key."""
    value = [c for c in old.columns if c != key]
    tagged = old.withColumn("_src", F.lit(0)).withColumn(order, F.lit(0).cast("long")).unionByName(
        new.select(key, *value, F.lit(1).alias("_src"), F.col(order).cast("long").alias(order))
    )
    best = tagged.groupBy(key).agg(F.max_by(F.struct(*value), F.struct("_src", order)).alias("v"))
    return best.select(key, "v.*")


def first_seen(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First occurrence per key by ``order``; partial aggregation keeps one row per key and task."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def number_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    return prefix_scan(df, [key], order, {"occurrence": ("sum", F.lit(1))})
