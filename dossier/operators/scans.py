"""Ordered scans that stay bounded when one key owns most of the rows.

A plain ``Window.partitionBy(key)`` puts a hot key into one task. Here the order
column is cut into blocks of 2**block_bits; a window runs inside each (key, block)
and the totals of earlier blocks, a table smaller by that factor, are carried in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import stage

BLOCK_BITS = 20


def _total(op: str, c: Column, order: Column) -> Column:
    if op == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[op](c)


def _running(op: str, c: Column) -> Column:
    if op == "last":
        return F.last(c, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[op](c)


def _merge(op: str, carried: Column, local: Column) -> Column:
    if op == "last":
        return F.coalesce(local, carried)
    if op == "sum":
        zero = F.lit(0)
        return F.coalesce(carried, zero) + F.coalesce(local, zero)
    return (F.greatest if op == "max" else F.least)(carried, local)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    block_bits: int = BLOCK_BITS,
    single_block: bool = False,
) -> DataFrame:
    """Add one running column per spec: name -> (op, value) with op sum, max, min or last.

    ``order`` is a bigint, unique within the keys; a null key is a key like any other. Rows up to the current one
    count; with ``exclusive`` only the rows before it. ``single_block`` skips the carry when the
    caller has checked that all rows share one block (see fits_one_block).
    """
    keys = list(keys)
    blk = "_blk"
    staged = df.withColumn(blk, F.shiftright(F.col(order), block_bits))
    for name, (_, value) in specs.items():
        staged = staged.withColumn(f"_v_{name}", value)
    upto = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    local = staged.select("*", *[_running(op, F.col(f"_v_{n}")).over(inside).alias(f"_l_{n}") for n, (op, _) in specs.items()])
    if single_block:
        zero = {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) if op == "sum" else F.col(f"_l_{n}") for n, (op, _) in specs.items()}
        return local.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in zero.items()])
    totals = staged.groupBy(*keys, blk).agg(
        *[_total(op, F.col(f"_v_{n}"), F.col(order)).alias(f"_t_{n}") for n, (op, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(blk).alias("_k_blk"),
        *[_running(op, F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (op, _) in specs.items()],
    )
    same = F.col(blk).eqNullSafe(F.col("_k_blk"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry, same, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(op, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (op, _) in specs.items()],
    )


PART, AT = "_part", "_at"


def range_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` written in the order of ``keys``, then ``order``, over range partitions, with the columns _part and _at (a place).

    Any sortable columns will do: strings, structs, several of them; nulls come first. A key with most of the rows covers many
    partitions. Rows equal in all of them stay in one partition, in no set order. Nothing is packed into bits, so ids may be
    hashes and positions as large as they come.
    """
    by = [*keys, *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id())
    return stage(sorted_.withColumn(PART, F.shiftright(AT, 33).cast("int")))


def scan_ranges(ranged: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """One running column per spec, as in prefix_scan, over the output of range_sort (or columns added to it).

    A window runs inside (partition, key). What a partition leaves behind for the next ones is one row: the totals of its last
    key, as only that one may go on. A null key is a key like any other.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    valued = ranged.select("*", *[value.alias(f"_v_{n}") for n, (_, value) in specs.items()])
    upto = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, upto)
    local = valued.select("*", key.alias("_key"), *[_running(op, F.col(f"_v_{n}")).over(inside).alias(f"_l_{n}") for n, (op, _) in specs.items()])
    edges = ranged.groupBy(PART).agg(F.min_by(key, AT).alias("first"), F.max_by(key, AT).alias("last"))
    kept = valued.join(F.broadcast(edges.select(PART, "last")), PART).filter(key.eqNullSafe(F.col("last")))
    totals = kept.groupBy(PART).agg(F.first("last").alias("_key"), *[_total(op, F.col(f"_v_{n}"), F.col(AT)).alias(f"_t_{n}") for n, (op, _) in specs.items()])
    left = totals.withColumn("_side", F.lit(1)).unionByName(edges.select(PART, F.col("first").alias("_key"), F.lit(0).alias("_side")), allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy(PART, "_side").rowsBetween(Window.unboundedPreceding, -1)
    carry = left.select(
        F.col(PART).alias("_cpart"), F.col("_key").alias("_ckey"), "_side", *[_running(op, F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (op, _) in specs.items()]
    ).filter("_side = 0")
    joined = local.join(F.broadcast(carry), (F.col(PART) == F.col("_cpart")) & F.col("_key").eqNullSafe(F.col("_ckey")), "left")
    return joined.select(*[F.col(c) for c in ranged.columns], *[_merge(op, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (op, _) in specs.items()])


def range_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """prefix_scan over columns of any kind: sorted once into range partitions, then one window per partition and one carry row each."""
    return scan_ranges(range_sort(df, keys, order), keys, specs, exclusive).drop(PART, AT)


def fits_one_block(staged: DataFrame, order: str, block_bits: int = BLOCK_BITS) -> bool:
    """Whether a written table is small enough for one block; reads only the order column."""
    lo, hi = staged.agg(F.min(order), F.max(order)).first()
    return lo is None or lo >> block_bits == hi >> block_bits


def compose_order(major: Column, minor: Column, minor_bits: int = 20) -> Column:
    """One sortable bigint out of (row number, position inside the row)."""
    return F.shiftleft(major.cast("long"), minor_bits) + minor.cast("long")
