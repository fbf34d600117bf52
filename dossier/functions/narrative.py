"""Text blocks built out of structured findings, answers, passages, sources and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import EMPTY_TEXTS, name_key, strip

E = F.lit


def _join(parts: list[Column], sep: str) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), sep)


def _some(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0)) > 0


def question_answers(qa: Column) -> Column:
    """'  Q: ..' / '  A: ..' lines of a map, or '  (none)'."""
    lines = F.transform(F.map_entries(qa), lambda e: F.concat(E("  Q: "), e["key"], E("\n  A: "), e["value"]))
    return F.when(_some(lines), F.array_join(lines, "\n")).otherwise(E("  (none)"))


def conversation_text(symptoms: Column, answers: Column, flags: Column, urgency: Column, complaint: Column, followups: Column) -> Column:
    """Narrative of one conversation; blank parts are skipped."""
    return _join(
        [
            F.when(_some(symptoms), F.concat(E("Presenting symptoms: "), F.array_join(symptoms, ", "))),
            F.when(_some(F.map_keys(answers)), F.concat(E("Patient interview responses:\n"), question_answers(answers))),
            F.when(_some(flags), F.concat(E("Red flags identified: "), F.array_join(flags, ", "))),
            F.when((urgency != "") & (urgency != "unknown"), F.concat(E("Urgency: "), urgency)),
            F.when(complaint != "", F.concat(E("Patient complaint: "), complaint)),
            F.when(_some(F.map_keys(followups)), F.concat(E("Triage follow-up responses:\n"), question_answers(followups))),
        ],
        "\n",
    )


def finding_query(symptoms: Column, urgency: Column, findings: Column, flags: Column) -> Column:
    """Retrieval query text out of structured findings."""
    names = F.when(_some(symptoms), F.array_join(symptoms, ", ")).otherwise(E("unspecified complaint"))
    lines = F.transform(
        F.map_entries(findings), lambda e: F.concat(E("  - "), F.replace(e["key"], E("_"), E(" ")), E(": "), e["value"])
    )
    return _join(
        [
            F.concat(E("Patient presenting with: "), names, E(". Urgency: "), urgency, E(".")),
            F.when(_some(lines), F.concat(E("Clinical findings: "), F.array_join(lines, " "))),
            F.when(_some(flags), F.concat(E("Red flags present: "), F.array_join(flags, ", "), E("."))),
        ],
        " ",
    )


def refined_query(complaint: Column, answers: Column) -> Column:
    lines = F.transform(F.map_entries(answers), lambda e: F.concat(E("  - "), e["key"], E(": "), e["value"]))
    return _join(
        [
            F.concat(E("Patient complaint: "), complaint, E(".")),
            F.when(_some(lines), F.concat(E("Patient history from follow-up questions: "), F.array_join(lines, " "))),
        ],
        " ",
    )


def enriched_query(base: Column, followups: Column) -> Column:
    pairs = F.transform(F.map_entries(followups), lambda e: F.concat(e["key"], E(": "), e["value"]))
    return F.concat(base, E(" Additional context: "), F.array_join(pairs, " "))


def finding_block(symptoms: Column, urgency: Column, findings: Column, flags: Column, history: Column) -> Column:
    """Structured findings as lines; ``flags`` is array<struct(flag, urgency)>."""
    lines = F.transform(
        F.map_entries(findings),
        lambda e: F.concat(E("  "), F.initcap(F.replace(e["key"], E("_"), E(" "))), E(": "), e["value"]),
    )
    flag_lines = F.transform(flags, lambda f: F.concat(E("  - "), f["flag"], E(" ["), f["urgency"], E("]")))
    return _join(
        [
            F.concat(E("Presenting symptoms: "), F.when(_some(symptoms), F.array_join(symptoms, ", ")).otherwise(E("N/A"))),
            F.concat(E("Urgency level: "), F.upper(urgency)),
            E(""),
            E("Clinical findings:"),
            F.when(_some(lines), F.array_join(lines, "\n")).otherwise(E("  (none recorded)")),
            F.when(_some(flag_lines), F.concat(E("\nRed flags:\n"), F.array_join(flag_lines, "\n"))),
            F.when(history != "", F.concat(E("\nPatient background (from previous sessions):\n"), history)),
        ],
        "\n",
    )


def clean_flags(flags: Column) -> Column:
    """Keep flag name and urgency, drop blank names, default urgency routine."""
    return F.transform(
        F.filter(flags, lambda f: F.coalesce(f["flag"], E("")) != ""),
        lambda f: F.struct(f["flag"].alias("flag"), F.coalesce(f["urgency"], E("routine")).alias("urgency")),
    )


def first_urgent_action(urgency: Column, rules: Column) -> Column:
    """Action of the first urgent rule; fixed texts for the other levels. rules: array<struct(urgency, action)>."""
    first = F.get(F.filter(rules, lambda r: r["urgency"] == "urgent"), F.lit(0))
    routine = E("Routine clinical assessment.")
    return (
        F.when(urgency == "emergency", E("EMERGENCY — activate emergency response immediately."))
        .when((urgency == "urgent") & first.isNotNull(), F.coalesce(first["action"], E("Urgent evaluation required.")))
        .otherwise(routine)
    )


def passage(i: Column, chapter: Column, section: Column, text: Column, score: Column) -> Column:
    shown = F.when(score.isNotNull(), F.format_string("  [rerank score: %.4f]", score)).otherwise(E(""))
    return F.concat(
        E("--- Passage "), i.cast("string"), E(" ---\nChapter : "), chapter,
        E("\nSection : "), section, shown, E("\n\n"), strip(text),
    )


def source_block(i: Column, title: Column, url: Column, content: Column, snippet: Column) -> Column:
    text = F.coalesce(F.nullif(content, E("")), F.nullif(snippet, E("")), E("(no content fetched)"))
    return F.concat(E("[Source "), i.cast("string"), E("] "), title, E("\nURL: "), url, E("\n"), text)


# The eleven fields of a record that become text rows of their own.
RECORD_FIELDS = (
    ("definition", "DEFINITION", "one_sentence_definition"),
    ("essential_questions", "ESSENTIAL QUESTIONS", "essential_questions"),
    ("system_differentials", "SYSTEM DIFFERENTIALS", "system_differentials"),
    ("possible_causes", "POSSIBLE CAUSES", "possible_causes"),
    ("red_flags", "RED FLAGS", "red_flags"),
    ("when_to_refer_emergency", "WHEN TO REFER - EMERGENCY", "when_to_refer_emergency"),
    ("key_examination_findings", "KEY EXAMINATION FINDINGS", "key_examination_findings"),
    ("useful_diagnostic_tests", "USEFUL DIAGNOSTIC TESTS", "useful_diagnostic_tests"),
    ("triage_logic", "TRIAGE LOGIC", "triage_logic"),
    ("specialty_routing", "SPECIALTY ROUTING", "specialty_routing"),
    ("rag_summary", "RAG SUMMARY", "rag_summary"),
)

# List fields of the compact document form and their titles.
DOCUMENT_LISTS = (
    ("essential_questions", "Essential questions:"),
    ("system_differentials", "System differentials:"),
    ("possible_causes", "Possible causes:"),
    ("red_flags", "Red flags:"),
    ("when_to_refer_emergency", "When to refer to emergency:"),
)


def record_rows(fields: dict[str, Column], symptom: Column) -> Column:
    """array<struct(id, section, title, text)> of the non-empty fields; lists become bullets.

    ``fields`` maps a field name to a string or array<string> column; missing names count as empty.
    """
    name = F.coalesce(F.nullif(strip(symptom), E("")), E("UNKNOWN"))
    slug = F.replace(F.lower(name), E(" "), E("_"))
    rows = []
    for key, title, field in RECORD_FIELDS:
        if field not in fields:
            continue
        rows.append(
            F.struct(
                F.concat(slug, E(f"::{key}")).alias("id"),
                E(key).alias("section"),
                E(title).alias("title"),
                fields[field].alias("content"),
            )
        )
    kept = F.filter(F.array(*rows), lambda r: F.coalesce(r["content"], E("")) != "")
    return F.transform(
        kept,
        lambda r: F.struct(
            r["id"].alias("id"),
            r["section"].alias("section"),
            r["title"].alias("title"),
            F.concat(E("Symptom: "), name, E("\nSection: "), r["title"], E("\n\n"), r["content"]).alias("text"),
        ),
    )


def bullets(items: Column) -> Column:
    kept = F.filter(items, lambda x: strip(x) != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(E("- "), x)), "\n")


def record_document(symptom: Column, definition: Column, lists: dict[str, Column]) -> Column:
    parts = [
        F.concat(E("Symptom: "), F.coalesce(symptom, E(""))),
        F.concat(E("Definition: "), F.coalesce(definition, E(""))),
    ]
    for field, title in DOCUMENT_LISTS:
        if field in lists:
            arr = lists[field]
            body = F.array_join(F.transform(arr, lambda x: F.concat(E("- "), x)), "\n")
            parts.append(F.when(_some(arr), F.concat(E(title + "\n"), body)))
    return _join(parts, "\n")


def smoking_text(smoking: Column) -> Column:
    """Human-readable smoking history out of a map; '' when it says nothing."""

    def val(k: str) -> Column:
        return F.nullif(F.try_element_at(smoking, E(k)), E(""))

    return _join(
        [
            F.concat(val("status"), E(" smoker")),
            val("duration"),
            val("quantity"),
            F.concat(E("quit "), val("quit")),
        ],
        " — ",
    )


def patient_key(c: Column) -> Column:
    return name_key(c)


def merge_answers(existing: Column, new: Column) -> Column:
    """Map union where the new answer wins."""
    kept = F.map_filter(existing, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def capped_followups(questions: Column, cap: int = 3) -> Column:
    return F.coalesce(F.slice(questions, 1, cap), F.expr(EMPTY_TEXTS))
