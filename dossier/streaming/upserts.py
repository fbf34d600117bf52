"""Keyed tables kept current by micro-batches.

A table is a folder epoch=E/bucket=B. A batch rewrites only the buckets its keys fall into, under its own
epoch, so repeating a failed batch writes the same files again; readers take the newest epoch of each
bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.feedback import split_reviews

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(table: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """First version of a table, epoch -1."""
    full = table.withColumn("epoch", F.lit(-1)).withColumn("bucket", _bucket(key, buckets))
    full.write.mode("overwrite").partitionBy("epoch", "bucket").parquet(path)


def read_current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version of every bucket; ``before`` hides an epoch that is being rewritten."""
    data = spark.read.parquet(path)
    if before is not None:
        data = data.filter(F.col("epoch") < before)
    newest = data.select("bucket", "epoch").distinct().groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return data.join(newest, ["bucket", "epoch"], "left_semi")


def upsert_batch(batch: DataFrame, epoch: int, path: str, key: str, order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merge a micro-batch: the last row per key by ``order`` replaces the stored one."""
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    current = read_current(spark, path, before=epoch)
    columns = [c for c in current.columns if c not in ("epoch", "bucket")]
    value = [c for c in columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("n"))
    fresh = last.withColumn("bucket", _bucket(key, buckets))
    touched = current.join(fresh.select("bucket").distinct(), "bucket", "left_semi").select(key, "bucket", F.struct(*value).alias("o"))
    merged = touched.join(fresh, [key, "bucket"], "full_outer")
    out = merged.select(key, "bucket", F.coalesce("n", "o").alias("v")).select(key, "bucket", "v.*").withColumn("epoch", F.lit(epoch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(path)


def upsert_sink(path: str, key: str, order: Sequence[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``."""
    return lambda batch, epoch: upsert_batch(batch, epoch, path, key, order, buckets)


def review_sink(path: str, rejects: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Reviews into the case table (case_id, review_status, doctor_diagnosis, reviewed_at); invalid ones aside."""

    def apply(batch: DataFrame, epoch: int) -> None:
        valid, invalid = split_reviews(batch)
        rows = valid.select(
            "case_id", F.col("doctor_decision").alias("review_status"), F.nullif(F.trim("doctor_diagnosis"), F.lit("")).alias("doctor_diagnosis"), "reviewed_at"
        )
        upsert_batch(rows, epoch, path, "case_id", ["reviewed_at"], buckets)
        invalid.write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")

    return apply


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Copy the newest versions to a new folder so old epochs can be retired by the owner."""
    read_current(spark, path).withColumn("epoch", F.lit(-1)).write.mode("overwrite").partitionBy("epoch", "bucket").parquet(target)


