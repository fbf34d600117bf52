"""Sinks: record tables, error records, training lines, comparison tables, embeddings, the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.experiments import ordered_table
from dossier.operators.feedback import training_rows


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A record table as JSON lines, one file per task."""
    df.write.mode(mode).json(path)


def with_error_records(parsed: DataFrame, key: str, payload: str) -> DataFrame:
    """Parsed rows as they are; failed ones become {key, error}, so the output stays complete."""
    failed = F.to_json(F.struct(F.col(key), F.lit("parsing_failed").alias("error")))
    return parsed.select(F.coalesce(payload, failed).alias("value"))


def write_parsed(parsed: DataFrame, key: str, payload: str, path: str) -> None:
    with_error_records(parsed, key, payload).write.mode("overwrite").text(path)


def training_lines(cases: DataFrame) -> DataFrame:
    rows = training_rows(cases)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_training_data(cases: DataFrame, path: str) -> None:
    training_lines(cases).write.mode("overwrite").text(path)


def write_comparison(table: DataFrame, path: str) -> None:
    """The small comparison table (one row per approach) as one CSV file in tie-break order."""
    ordered_table(table).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_embeddings(encoded: DataFrame, path: str, model: str, dim: int, prefix: str, created_at: str) -> None:
    """Good vectors as parquet, plus one metadata row; failed rows are counted, not written."""
    good = encoded.filter("error is null").drop("error")
    good.write.mode("overwrite").parquet(f"{path}/vectors")
    failed = encoded.filter("error is not null").count()
    meta = encoded.sparkSession.read.parquet(f"{path}/vectors").agg(F.count("*").alias("count"))
    meta.select(
        F.lit(model).alias("model"), F.lit(dim).alias("dim"), "count", F.lit(failed).alias("failed"), F.lit(prefix).alias("prefix_strategy"), F.lit(created_at).alias("created_at")
    ).write.mode("overwrite").json(f"{path}/metadata")


def write_store(vectors: DataFrame, path: str, force: bool = False, partition: str = "chapter") -> None:
    """The vector table, foldered for pruning. ``force`` rebuilds it, else an existing one is kept."""
    vectors.write.mode("overwrite" if force else "ignore").partitionBy(partition).parquet(path)


def check_count(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """One row: PASS or FAIL with the number of missing or extra rows."""
    n = spark.read.parquet(path).agg(F.count("*").alias("actual"))
    gap = F.col("actual") - F.lit(expected)
    return n.select(
        F.lit(expected).alias("expected"), "actual",
        F.when(gap == 0, "PASS").otherwise("FAIL").alias("status"),
        F.greatest(-gap, F.lit(0)).alias("missing"), F.greatest(gap, F.lit(0)).alias("extra"),
    )
