"""Parsing of free-form responses: JSON objects, numbered lists, required keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import bind, strip

# Keys every structured record must carry.
REQUIRED_KEYS = (
    "symptom",
    "body_systems",
    "essential_questions",
    "red_flags",
    "differential_diagnosis",
    "urgency_rules",
    "specialty_routing",
    "key_history_points",
    "key_exam_findings",
    "initial_workup",
    "when_to_admit",
    "when_to_refer",
    "treatment_overview",
    "etiology",
    "epidemiology",
)


def json_candidates(raw: Column) -> list[Column]:
    """Whole text, fenced block, tagged block, outermost braces - in that order; '' where absent."""
    return [
        strip(raw),
        F.regexp_extract(raw, "(?s)```(?:json)?\\s*(.+?)\\s*```", 1),
        F.regexp_extract(raw, "(?is)<json>\\s*(.+?)\\s*</json>", 1),
        F.regexp_extract(raw, "(?s)\\{.+\\}", 0),
    ]


def extract_json(raw: Column, objects_only: bool = True) -> Column:
    """The first candidate that parses, as text; null when none does. Later candidates are only built
    when the earlier ones fail."""

    def good(x: Column) -> Column:
        ok = x.startswith("{") if objects_only else x != ""
        return F.when(ok & F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(*[good(x) for x in json_candidates(raw)])


def first_response(first: Column, retry: Column, default: Column) -> dict[str, Column]:
    """First response, else the strict retry, else the deterministic value, with flags."""
    a, b = extract_json(first), extract_json(retry)
    return {
        "payload": F.coalesce(a, b, default),
        "retry_used": a.isNull() & b.isNotNull(),
        "response_failure": a.isNull() & b.isNull(),
        "deterministic_fallback": a.isNull() & b.isNull(),
    }


def missing_keys(json_text: Column, required: tuple[str, ...] = REQUIRED_KEYS) -> Column:
    have = F.coalesce(F.json_object_keys(json_text), F.expr("cast(array() as array<string>)"))
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), have))


def numbered_list(text: Column, n: Column) -> Column:
    """Items 1..n of a '1. text' / '2) text' reply; missing numbers become ''; the last one wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike("^[0-9]{1,9}[.)]"))
    items = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, "^([0-9]+)[.)]", 1).cast("int").alias("n"),
            strip(F.regexp_extract(x, "(?s)^[0-9]+[.)](.*)$", 1)).alias("t"),
        ),
    )

    def ordered(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.coalesce(F.get(F.reverse(F.filter(found, lambda e: e["n"] == i)), F.lit(0))["t"], F.lit("")),
        )

    return F.when(n < 1, F.expr("cast(array() as array<string>)")).otherwise(bind(items, ordered))
