"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
FILTER_BITS = 26
SLICE_BITS = 14

# Plain malloc, so that give_back really empties a worker; Arrow's own allocator keeps pages for later.
pa.set_memory_pool(pa.system_memory_pool())

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x ^= x >> np.uint64(30)
        x *= MIX_A
        x ^= x >> np.uint64(27)
        x *= MIX_B
        x ^= x >> np.uint64(31)
        return x


def text_slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts add up to about ``budget`` bytes; at least one row each.

    A batch holds a fixed number of rows, whatever their length. Work that expands text many times over
    runs on these pieces, so its memory follows the budget and the longest single text.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ragged(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def probably_in(df: DataFrame, key: Column, keys: DataFrame, mark: str | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (one column): all that are, and some more.

    With ``mark`` all rows stay and a boolean column of that name tells which may be.

    The keys become a bit set of 2**bits bits, 8 MiB by default whatever their number, cut into slices of 2 KiB.
    That bound is what allows the broadcast. As the set fills up, fewer rows are held back and an exact join,
    which always has to follow, does more; no row is lost. The caller's row travels as one struct, so its columns may have any
    names but ``mark``. A null key is a value like any other; repeated rows stay repeated; no keys: no row may be among them.
    """
    slices = bits - SLICE_BITS
    (name,) = keys.columns

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        return F.shiftrightunsigned(h, 64 - slices).cast("int"), F.shiftrightunsigned(h, 64 - bits).bitwiseAND((1 << SLICE_BITS) - 1).cast("int")

    part, at = place(F.col(name))
    words = keys.select(part.alias("slice"), F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(31)).alias("bit"))
    words = words.groupBy("slice", "word").agg(F.bit_or("bit").alias("bits"))
    packed = words.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    held = packed.select(
        "slice", F.transform(F.sequence(F.lit(0), F.lit((1 << SLICE_BITS - 5) - 1)), lambda i: F.coalesce(F.col("words")[i], F.lit(0))).alias("set")
    )
    part, at = place(key)
    probe = df.select(F.struct("*").alias("row"), part.alias("slice"), at.alias("at"))
    hit = F.call_function("shiftrightunsigned", F.get("set", F.shiftright("at", 5)), F.col("at").bitwiseAND(31)).bitwiseAND(1) == 1
    if mark:
        return probe.join(F.broadcast(held), "slice", "left").select("row.*", F.coalesce(hit, F.lit(False)).alias(mark))
    return probe.join(F.broadcast(held), "slice").filter(hit).select("row.*")
