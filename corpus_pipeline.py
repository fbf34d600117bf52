"""From documents to sampled token sequences: quality, exact copies, near copies, mixing, encoding.

Every stage reads what its predecessor kept and is written as Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import golomb_dedup, ordinal_quality, partenum, sampled_pieces, soft_mixing
from dossier.llm.common import table
from dossier.llm.queries import tokenizer_file
from dossier.session import ship_package, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier finds good enough."""
    ship_package(spark)
    return ordinal_quality.keep_good(docs, ordinal_quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    ship_package(spark)
    return golomb_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest id."""
    ship_package(spark)
    return partenum.keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic text is thinned towards a half and a quarter of its shares; documents that are mostly clean stay.

    The model is fitted on the labels of the whole table, as few of the poor and toxic documents get this far.
    """
    ship_package(spark)
    return soft_mixing.thin(docs, table(spark, sf_dir, "labels"), labelled=table(spark, sf_dir, "documents"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document that is left, in small slices, as the workers still hold what earlier stages left them."""
    ship_package(spark)
    return sampled_pieces.sample_segmentations(docs, tokenizer_file("piece_bpe_32k.model"), slice_bytes=1 << 17, node_cache=1 << 19)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixing", mixing), ("encoding", encoding)]

#: The classifiers, the sampling and the hashes have no SQL form; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
