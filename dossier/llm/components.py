"""Connected components by random hooking on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, both bigint); two nodes share a root iff connected.

    Each round every node moves to the neighbour with the smallest hash of (round, id), if it is smaller than its own,
    and the edges are rewritten to the new ends. The number of nodes falls by a constant factor per round
    in expectation, also on chains. All steps are grouped minima and equi-joins with one row per key on one
    side, so a hub's edges are combined before the shuffle or split by the engine. Every round is a written table.
    Edges with a null end or equal ends are ignored. No edges: no rows.
    """
    clean = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a <> b")
    current = stage(clean.distinct())
    moves: list[DataFrame] = []
    while not current.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(moves)), c)  # noqa: E731, B023
        both = current.union(current.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("h"), F.col("b").alias("id"))).alias("m"))
        target = F.when(F.col("m.h") < rank(F.col("a")), F.col("m.id")).otherwise(F.col("a"))
        move = stage(best.select(F.col("a").alias("node"), target.alias("to")))
        moves.append(move)
        ends = (
            current.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .filter("a <> b")
        )
        current = stage(ends.distinct())
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        out = out.join(step, "to", "left").select("node", F.coalesce("_next", "to").alias("to"))
    return out.select("node", F.col("to").alias("root"))
