"""Readers for markdown reports: named sections, primary finding, urgency words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WS, WS_CHARS, bind, strip

# Urgency synonyms.
URGENCY = {
    "routine": "routine",
    "low": "routine",
    "medium": "urgent",
    "urgent": "urgent",
    "high": "emergency",
    "emergency": "emergency",
    "critical": "emergency",
}
URGENCY_RANK = {"routine": 0, "urgent": 1, "emergency": 2}
SUMMARY_CHARS = 2000

_HEAD = "## primary diagnosis"


def _match_or_null(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def primary_line(report: Column) -> Column:
    """First content line under the primary heading, else the first 80 characters."""
    tail = _match_or_null(report, f"(?is)^(?:.*?\n)?{WS}*{_HEAD}[^\n]*\n(.*)$", 1)
    line = _match_or_null(tail, f"(?i)^(?:{WS}*{_HEAD}[^\n]*\n)*{WS}*([^#{WS_CHARS}][^\n]*)", 1)
    found = strip(F.substring_index(F.ltrim(strip(line), F.lit("- *")), "(", 1))
    fallback = strip(F.replace(F.substring(report, 1, 80), F.lit("\n"), F.lit(" ")))
    return (
        F.when(F.coalesce(report, F.lit("")) == "", F.lit("Unknown"))
        .when(line.isNull(), fallback)
        .when(found == "", F.lit("Unknown"))
        .otherwise(found)
    )


def primary_clean(report: Column) -> Column:
    """Primary finding without bullets and confidence notes; null when the section is missing."""
    body = _match_or_null(report, "(?is)##\\s*Primary\\s+Diagnosis\\s*\n+(.+?)(?:\n\n|\n##|\\z)", 1)
    lines = F.filter(
        F.transform(F.split(strip(body), "\n"), lambda x: strip(F.ltrim(strip(x), F.lit("-*•")))), lambda x: x != ""
    )

    def tidy(first: Column) -> Column:
        bare = strip(F.regexp_replace(first, "(?i)\\s*[\\(\\[].*?confidence.*?[\\)\\]]", ""))
        return F.nullif(strip(F.rtrim(bare, F.lit(":"))), F.lit(""))

    return bind(F.get(lines, F.lit(0)), tidy)


def section_pattern(name: str) -> str:
    return f"(?is)(?:#+\\s*)?{re.escape(name)}\\s*\n(.*?)(?=\n#+\\s|\\z)"


def section(report: Column, name: str) -> Column:
    return strip(_match_or_null(report, section_pattern(name), 1))


def without_section(report: Column, name: str) -> Column:
    return strip(F.regexp_replace(report, section_pattern(name), ""))


def urgency_level(c: Column) -> Column:
    key = F.lower(strip(c))
    level = F.lit("unknown")
    for word, value in URGENCY.items():
        level = F.when(key == word, F.lit(value)).otherwise(level)
    return level


def urgency_rank(c: Column) -> Column:
    rank = F.lit(0)
    for word, value in URGENCY_RANK.items():
        if value:
            rank = F.when(c == word, F.lit(value)).otherwise(rank)
    return rank


def urgency_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in URGENCY_RANK]), rank + 1)


def report_row(report: Column, urgency: Column) -> list[Column]:
    """The eight section fields of a stored report with their fallbacks and defaults."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(section(report, n), F.lit("")) for n in names])

    summary = F.substring(without_section(report, "Clinical Reasoning"), 1, SUMMARY_CHARS)
    return [
        first("Clinical Reasoning").alias("history"),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("Assessment completed.")).alias("summary_text"),
        first("Primary Diagnosis").alias("suspected"),
        first("Red Flags").alias("red_flags"),
        F.coalesce(
            first("Management Considerations", "Recommended"), F.lit("Follow up with your healthcare provider.")
        ).alias("recommended_action"),
        first("Recommended Investigations", "Investigations").alias("workup"),
        first("Specialist Referral", "Routing").alias("routing"),
        urgency_level(urgency).alias("urgency_level"),
    ]
