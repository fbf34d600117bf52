"""Readers with explicit schemas: tables, JSON records, JSON lines, one-document folders, word lists, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import first_non_empty, strip
from dossier.schemas import TABLES


SPREAD_BELOW = 256 << 20
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out over all cores.

    One small file often holds one row group and so feeds one task, however heavy the text work on
    its rows is. Tables above the limit already come in many splits and are left alone: no shuffle.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BELOW:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied parquet table, read with its declared schema (no inference pass over the files)."""
    df = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON-lines file; blank lines are skipped, malformed ones kept as text in ``bad``."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    whole = f"{schema}, _corrupt_record string"
    parsed = lines.select(
        "value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    )
    is_bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.filter(~is_bad).select("r.*").drop("_corrupt_record")
    return good, parsed.filter(is_bad).select(F.col("value").alias("raw"))


def read_document_folder(
    spark: SparkSession, folder: str, schema: str, skip: tuple[str, ...] = ("training_data.jsonl",)
) -> DataFrame:
    """One JSON document per file with its file name; unparsable files and the export file are left out."""
    whole = f"{schema}, _corrupt_record string"
    raw = spark.read.schema(whole).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    named = raw.withColumn("file_name", F.col("_metadata.file_name"))
    return named.filter(F.col("_corrupt_record").isNull() & ~F.col("file_name").isin(*skip)).drop("_corrupt_record")


def read_word_list(spark: SparkSession, path: str, min_length: int = 1) -> DataFrame:
    word = F.lower(strip(F.col("value")))
    return spark.read.text(path).select(word.alias("word")).filter(F.length("word") >= min_length).distinct()


def case_fields(raw: DataFrame, limit: int | None = None, order: str = "case_idx") -> DataFrame:
    """Benchmark cases with their alternative field names folded together, optionally the first N."""
    have = set(raw.columns)

    def pick(*names: str):
        return first_non_empty(*[F.col(n) for n in names if n in have])

    cases = raw.select(
        order,
        pick("patient_presentation", "case_prompt", "question").alias("case_prompt"),
        pick("ground_truth_diagnosis", "final_diagnosis", "answer").alias("ground_truth"),
        F.nullif(pick("source_chapter", "chapter"), F.lit("")).alias("source_chapter"),
    )
    return cases.orderBy(order).limit(limit) if limit else cases


def read_relational(spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, parts: int, **options: str) -> DataFrame:
    """A relational table in ``parts`` range slices of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi, numPartitions=parts, properties=options)
