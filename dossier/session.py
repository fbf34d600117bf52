"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "dossier", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


ARROW_BATCH = "8m"


def ship_package(spark: SparkSession) -> None:
    """Executors need the package for the Arrow functions: hand it out once per application.

    Arrow batches are cut by bytes, so that a batch of long texts takes no more memory than one of short ones, in the executor
    and in its Python workers; a size set by the owner of the session stays.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="dossier-pkg-"), "dossier")
        sc.addPyFile(shutil.make_archive(target, "zip", root, "dossier"))
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if sc.getConf().get("spark.sql.execution.arrow.maxBytesPerBatch") is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only when none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="dossier-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


BROADCAST_ROWS = 100_000


def small_side(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a written table for broadcast when it is known to be small, else leave the join to the planner."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a costly column made once a row: as a plain projection it is put in place of its uses, once in every filter and flag."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(name)).alias(name)).select(*df.columns)


def stage(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Later branches read it with column pruning instead of recomputing it, and a lost
    executor costs nothing that is already written.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
