"""Review cases: status filters, statistics, training export, review upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import strip


def with_status(cases: DataFrame, status: str) -> DataFrame:
    """pending, confirmed, rejected, or reviewed (anything but pending)."""
    s = F.col("review_status")
    return cases.filter(s != "pending" if status == "reviewed" else s == status)


def statistics(cases: DataFrame) -> DataFrame:
    s = F.col("review_status")
    c, r = F.count_if(s == "confirmed"), F.count_if(s == "rejected")
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if(s == "pending").alias("pending_review"), c.alias("confirmed"), r.alias("rejected"),
        F.round(F.try_divide(c, c + r), 4).alias("confirmation_rate"),
    )


def common_corrections(cases: DataFrame, n: int = 10) -> DataFrame:
    """Most often rejected findings; the limit is a top-n over partial counts."""
    rejected = with_status(cases, "rejected").groupBy(F.coalesce("system_primary_diagnosis", F.lit("Unknown")).alias("system_diagnosis"))
    return rejected.agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "system_diagnosis").limit(n)


def expected_output(decision: Column, report: Column, corrected: Column) -> Column:
    right = F.coalesce(decision, F.lit("confirmed")) == "confirmed"
    return F.when(right, report).otherwise(F.coalesce(F.nullif(corrected, F.lit("")), report))


def training_rows(cases: DataFrame) -> DataFrame:
    """Reviewed cases as (case_id, expected_output, system_output, was_correct)."""
    d = F.col("doctor_decision")
    return with_status(cases, "reviewed").select(
        "case_id",
        expected_output(d, F.col("report"), F.col("doctor_diagnosis")).alias("expected_output"),
        F.col("report").alias("system_output"),
        (F.coalesce(d, F.lit("confirmed")) == "confirmed").alias("was_correct"),
        "patient_name", "urgency", "system_primary_diagnosis", "doctor_diagnosis",
    )


def split_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): the decision must be known and a rejection needs a correction."""
    d = F.lower(strip(F.col("doctor_decision")))
    known = F.coalesce(d.isin("confirmed", "rejected"), F.lit(False))
    fixed = strip(F.coalesce("doctor_diagnosis", F.lit(""))) != ""
    ok = known & ((d == "confirmed") | fixed)
    tagged = reviews.withColumn("doctor_decision", d).withColumn("_ok", ok)
    reason = F.when(~known, "unknown decision").otherwise("rejected without correction")
    return tagged.filter("_ok").drop("_ok"), tagged.filter(~F.col("_ok")).drop("_ok").withColumn("reason", reason)


def apply_reviews(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest valid review per case sets status, decision, diagnosis and time; other cases stay."""
    valid, _ = split_reviews(reviews)
    fields = F.struct("doctor_decision", "doctor_diagnosis", "reviewed_at")
    last = valid.groupBy("case_id").agg(F.max_by(fields, F.struct("reviewed_at", "review_id")).alias("r"))
    old = ["review_status", "doctor_decision", "doctor_diagnosis", "reviewed_at"]
    j = cases.join(last, "case_id", "left")
    touched = F.col("r").isNotNull()
    return j.select(
        *[c for c in cases.columns if c not in old],
        F.when(touched, F.col("r.doctor_decision")).otherwise(F.col("review_status")).alias("review_status"),
        F.when(touched, F.col("r.doctor_decision")).otherwise(F.col("doctor_decision")).alias("doctor_decision"),
        F.when(touched, F.nullif(strip(F.col("r.doctor_diagnosis")), F.lit(""))).otherwise(F.col("doctor_diagnosis")).alias("doctor_diagnosis"),
        F.when(touched, F.col("r.reviewed_at")).otherwise(F.col("reviewed_at")).alias("reviewed_at"),
    )
