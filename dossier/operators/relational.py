"""Lookups over the application tables: anti joins, lookup chains, latest rows, one-of-two-keys matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.scans import prefix_scan


def pending_reports(reports: DataFrame, feedback: DataFrame, key: str = "report_id") -> DataFrame:
    """Reports nobody has reviewed; only the key of the feedback side is read."""
    return reports.join(feedback.select(key), key, "left_anti")


def lookup_chain(base: DataFrame, *steps: tuple[DataFrame, str, str], how: str = "left") -> DataFrame:
    """Join ``base`` with each (table, key in what is joined so far, key of the table) in turn."""
    out = base
    for table, left_key, right_key in steps:
        out = out.join(table, out[left_key] == table[right_key], how)
    return out


def match_either_key(requests: DataFrame, people: DataFrame, ref: str, keys: tuple[str, str]) -> DataFrame:
    """Requests whose reference is one of two ids of a person: an equi join on exploded keys."""
    keyed = people.withColumn("_k", F.explode(F.array_distinct(F.array(*[F.col(k) for k in keys]))))
    hit = requests.join(keyed, F.col(ref) == F.col("_k")).drop("_k")
    return hit.dropDuplicates([*requests.columns, *[k for k in keys if k not in requests.columns]])


def assigned_or_any(sessions: DataFrame, assignments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Assigned doctor of the patient, else the smallest doctor id (one aggregated value)."""
    fallback = doctors.agg(F.min("doctor_id")).scalar()
    joined = sessions.join(assignments, "patient_id", "left")
    return joined.withColumn("doctor_id", F.coalesce("assigned_doctor", fallback)).drop("assigned_doctor")


def match_pending_cases(feedback: DataFrame, cases: DataFrame, person: str = "patient_name") -> DataFrame:
    """The i-th review of a person goes to that person's i-th pending case.

    Each review closes a case, so the next one finds the next. Both sides are numbered with bounded
    scans and meet on (person, number): no pairs inside a frequent name.
    """
    f = prefix_scan(feedback, [person], "feedback_id", {"nth": ("sum", F.lit(1))})
    c = prefix_scan(cases.filter("review_status = 'pending'"), [person], "case_id", {"nth": ("sum", F.lit(1))})
    return f.join(c, [person, "nth"], "left")


def latest_session(patients: DataFrame, sessions: DataFrame) -> DataFrame:
    """End time of each patient's latest session; patients without sessions keep null."""
    last = sessions.groupBy("patient_id").agg(
        F.max_by("ended_at", F.struct("started_at", "session_id")).alias("last_ended_at"), F.max("started_at").alias("last_started_at")
    )
    return patients.join(last, "patient_id", "left")


def last_n(sessions: DataFrame, key: str, order: list[Column], n: int = 3) -> DataFrame:
    """Last ``n`` rows per key; the limit is applied on both sides of the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return sessions.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def dashboard(patients: DataFrame, reports: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per doctor: patients assigned and reports still to review."""
    a = patients.groupBy("doctor_id").agg(F.count("*").alias("patients_assigned"))
    p = pending_reports(reports, feedback).groupBy("doctor_id").agg(F.count("*").alias("reports_pending"))
    both = a.join(p, "doctor_id", "full_outer")
    return both.select("doctor_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("patients_assigned", "reports_pending")])


# Message kind hidden from patients and the columns a patient may see of a session.
HIDDEN_KIND = "diagnosis"
PATIENT_COLUMNS = ("session_id", "status", "started_at", "ended_at")


def patient_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("message_type") != HIDDEN_KIND)


def patient_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(*[c for c in PATIENT_COLUMNS if c in sessions.columns])
