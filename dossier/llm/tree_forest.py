"""Near-duplicate vectors by a forest of random-projection trees with spill.

Per label and tree, a node is halved along a random direction at the median of a bounded sample of its rows; rows within
the spill width of the cut go both ways. Nodes are split several levels per pass until they are small, or until no
direction separates them. Vectors of a leaf are compared exactly, large leaves in blocks. A pair that meets in several
leaves is counted in the one with the smallest number, so links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import mix64
from dossier.llm.components import connected_components
from dossier.session import stage

THRESHOLD = 0.98
TREES = 4
LEAF = 512
SAMPLE_ROWS = 2048
LEVELS = 6
SPILL = 1.0
TRIES = 8
SHRINK = 0.8


def _direction(node: int, place: int, attempt: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([node & 0xFFFFFFFFFFFFFFFF, place, attempt]).standard_normal(dim)
    return d / np.linalg.norm(d)


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _grow(spill: float):
    """A node's sample -> its subtree: per inner place the chosen attempt (-1: no split) and the cut. Place p has children 2p + 1 and 2p + 2."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node, total = int(key[0]), int(rows["n"].iloc[0])
        x = _units(_stack(rows["embedding"]))
        scale = total / len(x)
        size = (1 << LEVELS) - 1
        attempts, cuts = np.full(size, -1, np.int32), np.zeros(size)
        width = spill / sqrt(x.shape[1])
        inside = {0: np.arange(len(x))}
        for place in range(size):
            own = inside.pop(place, None)
            if own is None or len(own) * scale <= LEAF or len(own) < 16:
                continue
            best = None
            for attempt in range(TRIES):
                y = x[own] @ _direction(node, place, attempt, x.shape[1])
                cut = float(np.median(y))
                left, right = y <= cut + width, y >= cut - width
                share = max(left.mean(), right.mean())
                if best is None or share < best[0]:
                    best = (share, attempt, cut, left, right)
            if best[0] > SHRINK:
                continue
            attempts[place], cuts[place] = best[1], best[2]
            if 2 * place + 2 < size:
                inside[2 * place + 1], inside[2 * place + 2] = own[best[3]], own[best[4]]
        return pd.DataFrame({"node": [node], "attempts": [attempts.tobytes()], "cuts": [cuts.tobytes()]})

    return run


def _route(spill: float):
    """Rows with their node's subtree -> a row for each child they fall into; ``final`` where the subtree has no more splits to try."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy()
            flat = batch.column("embedding")
            x = _units(_stack(flat.to_pylist()))
            width = spill / sqrt(x.shape[1])
            out_row, out_node, out_final = [], [], []
            for node in np.unique(nodes):
                own = np.flatnonzero(nodes == node)
                attempts = np.frombuffer(batch.column("attempts")[int(own[0])].as_py(), np.int32)
                cuts = np.frombuffer(batch.column("cuts")[int(own[0])].as_py())
                inside = {0: own}
                for place in range(2 * len(attempts) + 1):
                    rows = inside.pop(place, None)
                    if rows is None or not len(rows):
                        continue
                    if place >= len(attempts) or attempts[place] < 0:
                        child = int(mix64(np.array([node], np.int64).view(np.uint64) ^ mix64(np.array([place + 1], np.uint64))).view(np.int64)[0])
                        out_row.append(rows)
                        out_node.append(np.full(len(rows), child))
                        out_final.append(np.full(len(rows), place < len(attempts)))
                        continue
                    y = x[rows] @ _direction(int(node), place, int(attempts[place]), x.shape[1])
                    inside[2 * place + 1], inside[2 * place + 2] = rows[y <= cuts[place] + width], rows[y >= cuts[place] - width]
            rows = pa.array(np.concatenate(out_row))
            yield pa.record_batch({"node": np.concatenate(out_node), "cid": batch.column("cid").take(rows), "embedding": flat.take(rows), "final": np.concatenate(out_final)})

    return run


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = (int(k) for k in key)
        rows = rows.sort_values("cid")
        cid, block, many = rows["cid"].to_numpy(), rows["block"].to_numpy(), rows["many"].to_numpy()
        x = _units(_stack(rows["embedding"]))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        linked = np.flatnonzero(near.any(axis=1))
        if not len(linked):
            return pd.DataFrame({"cid": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        near = near[np.ix_(linked, linked)]
        cid, many = cid[linked], many[linked]
        lists = [np.asarray(v, np.int64) for v in rows["leaves"].iloc[linked]]
        earlier = np.unique(np.concatenate(lists))
        earlier = earlier[earlier < leaf]
        owned = near
        if len(earlier):
            seen = np.zeros((len(linked), len(earlier)), np.float32)
            for r, own in enumerate(lists):
                own = own[own < leaf]
                seen[r, np.searchsorted(earlier, own)] = 1
            owned = near & (seen @ seen.T == 0)
        root = np.arange(len(linked))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(root)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"cid": cid, "links": (owned * many[None, :]).sum(axis=1).astype(np.int64), "root": cid[root]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id bigint, embedding array<float>, label).

    Only vectors with equal, non-null labels are compared, by cosine in double precision; every link is checked, a pair that no
    leaf holds is missed (recall is measured in the tests). Null, empty or zero vectors and those with null or non-finite
    parts link with nothing, nor do vectors of different lengths. ``n_links`` counts the other rows linked directly, equal vectors included; component_id is the
    smallest vec_id reachable; kept holds where it is the row's own. Equal vectors are compared once. Floats stay floats on disk, other
    numbers become doubles; lengths are taken after scaling by the largest part, so very small and large vectors link too. An empty table gives
    no rows; other columns are ignored. ``spill`` is in standard deviations of the projected distance of a pair at the threshold.
    """
    width = spill * sqrt(2 - 2 * threshold)
    dims = F.size("embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & F.col("label").isNotNull() & (dims > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    rows = rows.select("vec_id", "embedding", "label", usable.alias("usable"), F.xxhash64("label", "embedding").alias("cid"))
    members = rows.select("vec_id", "usable", "cid")
    classes = stage(rows.filter("usable").groupBy("cid").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.count("*").alias("many")))

    roots = classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "cid", "embedding", "label")
    open_rows = stage(roots.select(F.xxhash64("tree", "label", F.size("embedding")).alias("node"), "cid", "embedding"))
    leaves: list[DataFrame] = []
    while not open_rows.isEmpty():
        counts = stage(open_rows.groupBy("node").agg(F.count("*").alias("n")))
        large = counts.filter(F.col("n") > LEAF)
        leaves.append(open_rows.join(counts.filter(F.col("n") <= LEAF).select("node"), "node", "left_semi").select("node", "cid", "embedding"))
        draw = F.pmod(F.xxhash64(F.lit(3), "node", "cid"), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE_ROWS * (1 << 20))
        sample = open_rows.join(large, "node").filter(draw)
        models = stage(sample.groupBy("node").applyInPandas(_grow(width), "node long, attempts binary, cuts binary"))
        routed = stage(open_rows.join(models, "node").mapInArrow(_route(width), f"node long, cid long, embedding {kind}, final boolean"))
        leaves.append(routed.filter("final").select("node", "cid", "embedding"))
        open_rows = routed.filter("not final").select("node", "cid", "embedding")
    held = leaves[0].select(F.col("node").alias("leaf"), "cid", "embedding") if leaves else open_rows.select(F.col("node").alias("leaf"), "cid", "embedding")
    for more in leaves[1:]:
        held = held.union(more.select(F.col("node").alias("leaf"), "cid", "embedding"))
    held = stage(held)

    lists = held.groupBy("cid").agg(F.collect_list("leaf").alias("leaves")).join(classes.select("cid", "many"), "cid")
    blocks = held.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("k"))
    placed = held.join(blocks, "leaf").join(lists, "cid").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "cid"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    paired = placed.withColumn("other", other).select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "block", "many", "leaves", "embedding")
    found = stage(paired.groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), "cid long, links long, root long"))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "many").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("cid", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    labelled = stage(members.filter("usable").select("vec_id", "cid").join(named, "cid"))
    smallest = labelled.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = labelled.join(smallest, "root").select("vec_id", "n_links", "component_id")
    alone = members.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
