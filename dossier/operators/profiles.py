"""Person profiles folded from session updates, as scalar rows, item rows and session rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.narrative import smoking_text
from dossier.operators.relational import last_n
from dossier.operators.scans import prefix_scan

LIST_FIELDS = ("known_conditions", "medications", "allergies", "family_history", "surgical_history")
DEMOGRAPHICS = ("age", "gender")


def fold_scalars(updates: DataFrame) -> DataFrame:
    """First non-empty demographics, last non-empty habit objects, session count and last update.

    All of it is algebraic, so a person with very many sessions is folded by partial aggregates.
    ``updates``: patient, ord (session order), session_ts, demographics, smoking_history, substance_use.
    """

    def first_filled(k: str) -> Column:
        v = F.nullif(F.try_element_at("demographics", F.lit(k)), F.lit(""))
        return F.min_by(v, F.when(v.isNotNull(), F.col("ord"))).alias(k)

    def last_filled(c: str) -> Column:
        full = F.coalesce(F.size(F.map_keys(c)), F.lit(0)) > 0
        return F.max_by(F.map_entries(c), F.when(full, F.col("ord"))).alias(c)

    g = updates.groupBy("patient").agg(
        *[first_filled(k) for k in DEMOGRAPHICS], last_filled("smoking_history"), last_filled("substance_use"),
        F.count("*").alias("sessions"), F.max("session_ts").alias("last_updated"),
    )
    return g.withColumn("smoking_history", F.map_from_entries("smoking_history")).withColumn("substance_use", F.map_from_entries("substance_use"))


def fold_items(updates: DataFrame, fields: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """Every list item ever added, in order: patient, field, ord, pos, name, detail."""
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields if f in updates.columns])
    lists = updates.select("patient", "ord", F.explode(tagged).alias("l"))
    return lists.select("patient", "ord", F.col("l.field").alias("field"), F.posexplode("l.items").alias("pos", "i")).select(
        "patient", "field", "ord", "pos", "i.name", "i.detail"
    )


def session_entries(updates: DataFrame) -> DataFrame:
    """Session history with a running number per person."""
    numbered = prefix_scan(
        updates.select("patient", "ord", "session_ts", "symptoms", "urgency", "diagnosis", "summary"),
        ["patient"], "ord", {"session_number": ("sum", F.lit(1))},
    )
    return numbered


PIECE_ITEMS = 200
_LAST = 2_000_000_000


def _pieces(items: DataFrame, shown: Column, piece_items: int) -> DataFrame:
    """(patient, field, part, text): items joined in order, at most ``piece_items`` to a piece.

    Later pieces open with the separator, so joining the pieces gives the whole list however long it is.
    """
    order = F.shiftleft(F.col("ord"), 20) + F.col("pos")
    rows = items.select("patient", "field", order.alias("o"), shown.alias("t"))
    n = prefix_scan(rows, ["patient", "field"], "o", {"n": ("sum", F.lit(1))}, block_bits=40)
    n = n.withColumn("part", F.floor((F.col("n") - 1) / piece_items).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda r: r["t"])
    joined = n.groupBy("patient", "field", "part").agg(F.array_join(texts, ", ").alias("t"))
    return joined.select("patient", "field", "part", F.concat(F.when(F.col("part") > 0, ", ").otherwise(""), "t").alias("text"))


def _with_detail(openings: dict[str, str]) -> Column:
    opening = F.lit(None).cast("string")
    for f, words in openings.items():
        opening = F.when(F.col("field") == f, F.lit(words)).otherwise(opening)
    detail = F.concat(opening, F.nullif("detail", F.lit("")), F.lit(")"))
    return F.concat("name", F.coalesce(detail, F.lit("")))


def _list_lines(pieces: DataFrame, labels: dict[str, tuple[int, str]], closing: str = "") -> DataFrame:
    """Rows (patient, line_no, part, text) of the list fields: label, pieces, closing text."""
    no, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for f, (n, words) in labels.items():
        no = F.when(F.col("field") == f, F.lit(n)).otherwise(no)
        label = F.when(F.col("field") == f, F.lit(words)).otherwise(label)
    named = pieces.filter(F.col("field").isin(*labels)).withColumn("line_no", no).withColumn("label", label)
    text = F.when(F.col("part") == 0, F.concat(F.lit("\n"), "label", "text")).otherwise(F.col("text"))
    lines = named.select("patient", "line_no", "part", text.alias("text"))
    if closing:
        ends = named.filter("part = 0").select("patient", "line_no", F.lit(_LAST).alias("part"), F.lit(closing).alias("text"))
        lines = lines.unionByName(ends)
    return lines


def _fixed_lines(rows: DataFrame, lines: list[tuple[int, Column]]) -> DataFrame:
    """Rows of single-piece lines; null lines vanish, line 0 opens the text without a newline."""
    made = F.array(*[F.struct(F.lit(n).alias("line_no"), t.alias("t")) for n, t in lines])
    out = rows.select("patient", F.explode(F.filter(made, lambda x: x["t"].isNotNull())).alias("l"))
    text = F.when(F.col("l.line_no") == 0, F.col("l.t")).otherwise(F.concat(F.lit("\n"), "l.t"))
    return out.select("patient", "l.line_no", F.lit(0).alias("part"), text.alias("text"))


def _recent(entries: DataFrame, text: Column, sep: str) -> DataFrame:
    last = last_n(entries, "patient", [F.col("ord").desc()], 3)
    return last.groupBy("patient").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda r: r["t"]), sep).alias("recent")
    )


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {label}: "), value))


def intake_context(scalars: DataFrame, items: DataFrame, entries: DataFrame, piece_items: int = PIECE_ITEMS) -> DataFrame:
    """History text for an intake, as pieces: patient, line_no, part, text.

    Joining ``text`` by (line_no, part) gives the text: known facts, last three sessions, facts to confirm.
    """
    visit = F.concat(
        F.date_format("session_ts", "yyyy-MM-dd"), F.lit(" ("), F.array_join("symptoms", ", "), F.lit(" → "),
        F.coalesce("diagnosis", F.lit("unknown")), F.lit(" diagnosed)"),
    )
    shown = _pieces(items, _with_detail({"known_conditions": " (since ", "medications": " (for "}), piece_items)
    plain = _pieces(items, F.col("name"), piece_items)
    has = items.groupBy("patient").agg(*[F.bool_or(F.col("field") == f).alias(f"has_{f}") for f in LIST_FIELDS])
    j = scalars.join(_recent(entries, visit, "; "), "patient", "left").join(has, "patient", "left")
    smoking = F.coalesce(smoking_text(F.col("smoking_history")), F.lit(""))
    times = F.when(F.col("sessions") == 1, F.lit(" session — ")).otherwise(F.lit(" sessions — "))
    confirmable = (smoking != "") | F.coalesce(F.col("has_known_conditions") | F.col("has_medications") | F.col("has_allergies") | F.col("has_surgical_history"), F.lit(False))
    ask = "Briefly CONFIRM these known facts with the patient (one sentence each, accept yes/no — if anything changed, record the update):"
    fixed = _fixed_lines(
        j,
        [
            (0, F.lit("Known patient history:")),
            (4, _labelled("Smoking", smoking)),
            (5, F.when(F.size(F.map_keys("substance_use")) > 0, F.concat(F.lit("- Substance use: "), F.to_json("substance_use")))),
            (8, _labelled("Previous sessions", F.concat(F.col("sessions").cast("string"), times, F.col("recent")))),
            (9, F.lit("")),
            (10, F.when(confirmable, F.lit(ask))),
            (11, F.when(smoking != "", F.concat(F.lit("  - smoking history ("), smoking, F.lit(")")))),
            (14, F.when(F.col("has_allergies"), F.lit("  - allergies"))),
            (15, F.when(F.col("has_surgical_history"), F.lit("  - surgical history"))),
            (16, F.when(confirmable, F.lit(""))),
            (17, F.lit("Focus your detailed questions on the NEW presenting complaint.")),
        ],
    )
    facts = {
        "known_conditions": (1, "- Conditions: "), "medications": (2, "- Medications: "), "allergies": (3, "- Allergies: "),
        "family_history": (6, "- Family history: "), "surgical_history": (7, "- Surgical history: "),
    }
    confirm = {"known_conditions": (12, "  - conditions ("), "medications": (13, "  - medications (")}
    return fixed.unionByName(_list_lines(shown, facts)).unionByName(_list_lines(plain, confirm, ")"))


def triage_context(scalars: DataFrame, items: DataFrame, entries: DataFrame, piece_items: int = PIECE_ITEMS) -> DataFrame:
    """History text for a triage, as pieces: background lists and the last three findings."""
    finding = F.when(
        F.coalesce("diagnosis", F.lit("")) != "",
        F.concat(F.lit("- Previous diagnosis: "), F.col("diagnosis"), F.lit(" ("), F.date_format("session_ts", "yyyy-MM-dd"), F.lit(")")),
    )
    shown = _pieces(items, _with_detail({"known_conditions": " (since "}), piece_items)
    j = scalars.join(_recent(entries, finding, "\n"), "patient", "left")
    smoking = F.coalesce(smoking_text(F.col("smoking_history")), F.lit(""))
    fixed = _fixed_lines(
        j,
        [
            (0, F.lit("Patient history:")),
            (4, _labelled("Smoking", smoking)),
            (7, F.nullif("recent", F.lit(""))),
            (8, F.lit("")),
            (9, F.lit("Consider this history when forming your differential diagnosis.")),
        ],
    )
    facts = {
        "known_conditions": (1, "- Known conditions: "), "medications": (2, "- Medications: "), "allergies": (3, "- Allergies: "),
        "family_history": (5, "- Family history: "), "surgical_history": (6, "- Surgical history: "),
    }
    return fixed.unionByName(_list_lines(shown, facts))
