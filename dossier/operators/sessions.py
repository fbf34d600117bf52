"""Session logs in batch: idle expiry, monotone urgency, pooled flags, phase changes.

Long-running keys are safe: all running values come from bounded scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.reports import urgency_name, urgency_rank
from dossier.operators.scans import fits_one_block, prefix_scan
from dossier.session import stage

TTL_MINUTES = 30
# Events of one user are cut into blocks of 2**36 microseconds, about nineteen hours.
TIME_BITS = 36


def expire_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = TTL_MINUTES) -> DataFrame:
    """Sessions of activity: one ends when the next event comes more than ``minutes`` later.

    A gap of exactly ``minutes`` continues the session.
    """
    e = events.select(key, F.unix_micros(ts).alias("us"))
    seen = prefix_scan(e, [key], "us", {"prev": ("max", F.col("us"))}, exclusive=True, block_bits=TIME_BITS)
    opens = F.col("prev").isNull() | (F.col("us") - F.col("prev") > minutes * 60 * 1_000_000)
    marked = stage(seen.withColumn("opens", opens))
    tagged = prefix_scan(
        marked, [key], "us", {"start": ("max", F.when(F.col("opens"), F.col("us")))},
        block_bits=TIME_BITS, single_block=fits_one_block(marked, "us", TIME_BITS),
    )
    s = tagged.groupBy(key, "start").agg(F.max("us").alias("last"), F.count("*").alias("events"))
    return s.select(
        key, F.timestamp_micros("start").alias("session_start"), F.timestamp_micros("last").alias("last_active"), "events"
    )


def monotone_urgency(messages: DataFrame) -> DataFrame:
    """Urgency never goes down along a conversation."""
    ranked = messages.withColumn("rank", urgency_rank(F.col("urgency")))
    out = prefix_scan(ranked, ["session_id"], "turn", {"top": ("max", F.col("rank"))})
    return out.withColumn("running_urgency", urgency_name(F.col("top"))).drop("rank", "top")


def session_state(messages: DataFrame) -> DataFrame:
    """Per session: highest urgency, distinct flags, answered questions."""
    return messages.groupBy("session_id").agg(
        urgency_name(F.max(urgency_rank(F.col("urgency")))).alias("urgency"),
        F.array_sort(F.collect_set("flag")).alias("flags"),
        F.count_if("answered").alias("answered"),
    )


def phase_changes(messages: DataFrame, phase: str = "phase") -> DataFrame:
    """Messages at which the phase differs from the one before, first messages included."""
    seen = prefix_scan(messages, ["session_id"], "turn", {"prev": ("last", F.col(phase))}, exclusive=True)
    return seen.filter(~F.col(phase).eqNullSafe(F.col("prev"))).withColumnRenamed("prev", "from_phase")


def pool_distinct(rows: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """Distinct items per key, first occurrence wins; one row per item so nothing is gathered."""
    return rows.groupBy(key, item).agg(F.min(F.struct(*order)).alias("first"))


def add_new_flags(existing: DataFrame, triggered: DataFrame) -> DataFrame:
    """Existing flags plus triggered ones whose (session, flag) is not there yet."""
    fresh = triggered.join(existing.select("session_id", "flag"), ["session_id", "flag"], "left_anti")
    first = fresh.groupBy("session_id", "flag").agg(F.min_by("urgency", "turn").alias("urgency"), F.min("turn").alias("turn"))
    return existing.unionByName(first.select(*existing.columns))
