"""Glyph frequency reports, page-range corrections, and the letter solver for unknown glyphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.glyphs import DAMAGED_WORD, PRIVATE_USE, code_of, distinct_codes, private_chars, repair
from dossier.operators.scans import AT, PART, range_scan, range_sort, scan_ranges
from dossier.session import small_side, stage

# Candidate replacements and the letter order that settles ties.
CANDIDATES = (*"abcdefghijklmnopqrstuvwxyz", "-", "'", ".")
LETTER_ORDER = "etaoinshrdlcumwfgypbvkjxqz"
CLOSE_CALL = 0.85


def glyph_frequency(texts: DataFrame, text: str) -> DataFrame:
    """Occurrences per private-use character; the explode feeds a partial count, not a shuffle of characters."""
    chars = texts.select(F.explode_outer(private_chars(F.col(text))).alias("glyph")).filter("glyph is not null")
    return chars.groupBy("glyph").agg(F.count("*").alias("n")).withColumn("code", code_of(F.col("glyph")))


def repair_texts(texts: DataFrame, glyph_map: DataFrame, text: str, fixed: str) -> DataFrame:
    """``texts`` with ``text`` repaired by its font's entries as ``fixed``.

    The map has a row per font, so it goes to the texts: a join by font would send a frequent font's texts to one task.
    """
    joined = texts.join(small_side(stage(glyph_map)), "font", "left")
    return joined.withColumn(fixed, repair(F.col(text), F.col("entries"))).drop("entries")


def word_counts(texts: DataFrame, font: str, text: str) -> DataFrame:
    """(font, word, n): the different damaged words of a font and how often each occurs, counted before they are shuffled.

    An inner explode would have its array computed a second time by an inferred filter on its size.
    """
    words = texts.select(F.col(font).alias("font"), F.explode_outer(F.regexp_extract_all(text, F.lit(DAMAGED_WORD), F.lit(0))).alias("word"))
    return words.filter("word is not null").groupBy("font", "word").agg(F.count("*").alias("n"))


def glyph_counts(texts: DataFrame, font: str, text: str) -> DataFrame:
    """(font, n, residual_chars): damaged words told apart by their unknown glyphs alone, far fewer than the words."""
    left = F.regexp_replace(text, "[^ \\n\\uE000-\\uF8FF]+", "")
    glyphs = texts.select(F.col(font).alias("font"), F.explode_outer(F.regexp_extract_all(left, F.lit(f"{PRIVATE_USE}+"), F.lit(0))).alias("glyphs"))
    counted = glyphs.filter("glyphs is not null").groupBy("font", "glyphs").agg(F.count("*").alias("n"))
    return counted.select("font", "n", distinct_codes(F.col("glyphs")).alias("residual_chars"))


def word_totals(texts: DataFrame, font: str, text: str) -> DataFrame:
    """(font, n): the number of damaged words of every text; no word leaves its row."""
    return texts.select(F.col(font).alias("font"), F.regexp_count(text, F.lit(DAMAGED_WORD)).cast("long").alias("n"))


def font_codes(texts: DataFrame, font: str, text: str) -> DataFrame:
    """The different (font, code) of the unknown glyphs."""
    glyphs = texts.select(F.col(font).alias("font"), F.explode_outer(F.array_distinct(private_chars(F.col(text)))).alias("glyph")).filter("glyph is not null").distinct()
    return glyphs.select("font", code_of(F.col("glyph")).alias("code"))


def _weight(flagged: DataFrame) -> Column:
    """Rows count once, or ``n`` times where they stand for several."""
    return F.sum("n") if "n" in flagged.columns else F.count("*")


def residual_by_font(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records per font, codepoint counts per font), most frequent first."""
    records = flagged.groupBy("font").agg(_weight(flagged).alias("records")).filter("records > 0")
    codes = _codes(flagged, "font") if "residual_chars" in flagged.columns else None
    return records.orderBy(F.col("records").desc(), "font"), codes and codes.orderBy("font", F.col("n").desc(), "code")


def _codes(flagged: DataFrame, *keys: str) -> DataFrame:
    """An inner explode would have an inferred filter on its array, put below the count of equal words: made twice for every word."""
    rows = flagged.select(*keys, *(["n"] if "n" in flagged.columns else []), F.explode_outer("residual_chars").alias("code")).filter("code is not null")
    return rows.groupBy(*keys, "code").agg(_weight(flagged).alias("n"))


def top_codes(flagged: DataFrame, n: int = 10) -> DataFrame:
    return _codes(flagged).orderBy(F.col("n").desc(), "code").limit(n)


def samples(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Up to ``n`` distinct values per group in value order."""
    w = Window.partitionBy(group).orderBy(value)
    few = df.select(group, value).distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return few.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("samples"))


def first_words(texts: DataFrame, font: str, text: str, n: int) -> DataFrame:
    """(font, word): the ``n`` first damaged words of every text in word order. Those of a font are among them, so no other word is shuffled."""
    words = F.regexp_extract_all(text, F.lit(DAMAGED_WORD), F.lit(0))
    first = F.filter(F.sort_array(F.array_distinct(words)), lambda _, i: i < n)
    return texts.select(F.col(font).alias("font"), F.explode_outer(first).alias("word")).filter("word is not null")


def font_profile(spans: DataFrame) -> DataFrame:
    bold = F.col("bold") if "bold" in spans.columns else F.lit(False)
    return spans.groupBy("font", F.round("size", 1).alias("size"), bold.alias("bold")).agg(F.count("*").alias("n"))


def _request_line(numbered: DataFrame) -> DataFrame:
    line = F.concat(
        F.col("entry").cast("string"), F.lit('. "'), F.col("word"), F.lit('"  (page '), F.col("page").cast("string"),
        F.lit(", residual PUA chars: "), F.array_join("residual_chars", ", "), F.lit(', surrounding context: "'), F.col("context"), F.lit('")'),
    )
    return numbered.select("font", "entry", line.alias("line"))


def request_blocks(flagged: DataFrame, fonts: tuple[str, ...]) -> DataFrame:
    """Numbered request lines per font, one row per entry so a frequent font stays many rows."""
    picked = flagged.filter(F.col("font").isin(*fonts))
    return _request_line(range_scan(picked, ["font"], ["ord"], {"entry": ("sum", F.lit(1))}))


def words_in_context(text: Column, around: int = 5) -> Column:
    """array<struct(word, at, context)>: the damaged words of a text, line by line, each with its place in its line and up to ``around`` words of its line on either side.

    One pattern cuts, at every word, that word and the 2 * ``around`` next ones: the context of the word ``around`` places on.
    The contexts of a line's first words are its beginnings. So a line costs as many characters as its contexts have.
    """
    ahead = F.lit(f"(?<![^ ])(?=((?:[^ ]*+ ){{0,{2 * around}}}[^ ]*+))[^ ]*+")

    def hits(line: Column) -> Column:
        first = F.array(*[F.substring_index(line, " ", around + 1 + i) for i in range(around)])
        near = F.concat(first, F.regexp_extract_all(line, ahead, F.lit(1)))
        words = F.split(line, " ")
        at = F.sequence(F.lit(0), F.size(words) - 1)
        return F.filter(F.arrays_zip(words.alias("word"), at.alias("at"), near.alias("context")), lambda w: w["word"].rlike(PRIVATE_USE))

    return F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(PRIVATE_USE)), hits))


def request_blocks_of_texts(texts: DataFrame, fonts: tuple[str, ...]) -> DataFrame:
    """request_blocks of all damaged words of ``texts``: font, page, text.

    Texts are ordered, and numbered by how many damaged words they hold; words and contexts are made afterwards, so nothing
    longer than the text is sorted or written. Only counts go through the window, which has few groups; a text finds its own by its place.
    """
    picked = texts.filter(F.col("font").isin(*fonts) & F.col("text").rlike(PRIVATE_USE)).select("font", "page", "text")
    ranged = range_sort(picked, ["font"], ["page"])
    counts = stage(ranged.select("font", PART, AT, F.regexp_count("text", F.lit(DAMAGED_WORD)).cast("long").alias("_n")))
    before = scan_ranges(counts, ["font"], {"_before": ("sum", F.col("_n"))}, exclusive=True).select(AT, "_before")
    words = ranged.join(before, AT).select("font", "page", "_before", F.posexplode_outer(words_in_context(F.col("text"))).alias("hit", "w"))
    numbered = words.select("font", "page", (F.col("_before") + F.col("hit") + 1).alias("entry"), "w.word", "w.context")
    return _request_line(numbered.withColumn("residual_chars", distinct_codes(F.col("word"))))


def new_entries(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    return proposed.join(existing, ["font", "code"], "left_anti")


def apply_corrections(sections: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply every correction to the sections whose pages cover it and whose text holds it, in correction order.

    Pages turn the range condition into an equi join on narrow keys; only each section's own list of
    corrections meets its text. Adds ``applied`` (ids that changed something) and ``n_applied``.
    ``corrections``: corr_id, page, original, corrected.
    """
    pages = sections.select("seq", F.explode(F.sequence("page_range.lo", "page_range.hi")).alias("page"))
    lists = (
        pages.join(corrections.select("page", "corr_id", "original", "corrected"), "page")
        .groupBy("seq")
        .agg(F.array_sort(F.collect_set(F.struct("corr_id", "original", "corrected"))).alias("corr"))
    )

    def holds(acc: Column, c: Column) -> Column:
        return acc["t"].contains(c["original"]) | acc["e"].contains(c["original"])

    def step(acc: Column, c: Column) -> Column:
        hit = holds(acc, c)
        return F.struct(
            F.replace(acc["t"], c["original"], c["corrected"]).alias("t"),
            F.replace(acc["e"], c["original"], c["corrected"]).alias("e"),
            F.when(hit, F.concat(acc["ids"], F.array(c["corr_id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    start = F.struct(
        F.col("text").alias("t"), F.coalesce("essentials_text", F.lit("")).alias("e"), F.expr("cast(array() as array<bigint>)").alias("ids")
    )
    out = sections.join(lists, "seq", "left")
    out = out.withColumn("_r", F.when(F.col("corr").isNotNull(), F.aggregate("corr", start, step)).otherwise(start))
    return (
        out.withColumn("text", F.col("_r.t"))
        .withColumn("essentials_text", F.col("_r.e"))
        .withColumn("applied", F.col("_r.ids"))
        .withColumn("n_applied", F.size("_r.ids"))
        .drop("_r", "corr")
    )


def unmatched_corrections(corrections: DataFrame, corrected: DataFrame) -> DataFrame:
    used = corrected.select(F.explode("applied").alias("corr_id")).distinct()
    return corrections.join(used, "corr_id", "left_anti")


def damaged_words(texts: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case words with an unknown glyph and how often they occur."""
    token = "([A-Za-z\\uE000-\\uF8FF][A-Za-z\\uE000-\\uF8FF'\\-.]*)"
    words = texts.select(F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(1))).alias("word"))
    return words.filter(F.col("word").rlike(PRIVATE_USE)).groupBy("word").agg(F.count("*").alias("n"))


def _apply(word: Column, mapping: dict[str, str]) -> Column:
    for glyph, letter in mapping.items():
        word = F.replace(word, F.lit(glyph), F.lit(letter))
    return word


def score_glyphs(bank: DataFrame, glyphs: Sequence[str], dictionary: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(glyph, candidate, score): occurrences of bank words that become dictionary words, for several glyphs in one pass.

    Distinct words meet the dictionary in a semi join keyed by the resolved word. Only words that the glyph completes are
    tried: one that keeps another damaged glyph is in no dictionary.
    """
    glyph = F.col("glyph")
    resolved = bank.withColumn("w", _apply(F.col("word"), mapping)).withColumn("glyph", F.explode(F.array(*[F.lit(g) for g in glyphs])))
    mine = resolved.filter(F.col("word").contains(glyph) & ~F.replace("w", glyph, F.lit("")).rlike(PRIVATE_USE))
    tries = mine.select("glyph", "n", "w", F.explode(F.array(*[F.lit(c) for c in CANDIDATES])).alias("candidate"))
    known = tries.select("glyph", "n", "candidate", F.replace("w", glyph, F.col("candidate")).alias("word")).join(dictionary, "word", "left_semi")
    return known.groupBy("glyph", "candidate").agg(F.sum("n").alias("score"))


def score_candidates(bank: DataFrame, glyph: str, dictionary: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(candidate, score) of one glyph, see score_glyphs."""
    return score_glyphs(bank, [glyph], dictionary, mapping).select("candidate", "score")


def _judge(scores: list[tuple[str, int]]) -> tuple[str, int, bool]:
    """(winner, score, certain) of one glyph: certain unless nothing matched or the runner-up is close."""
    full = dict.fromkeys(CANDIDATES, 0) | dict(scores)
    order = sorted(full.items(), key=lambda kv: (-kv[1], CANDIDATES.index(kv[0])))
    (winner, top), (_, second) = order[0], order[1]
    return winner, top, top > 0 and second / top < CLOSE_CALL


def solve_glyphs(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Letters for unknown glyphs, most frequent first, each solved glyph helping the next ones.

    The loop runs over the distinct glyphs (a small alphabet); counting runs on the cluster. A pass
    without progress ends it; the open glyphs get one more try and keep their best guess if they
    have one.
    """
    spark = texts.sparkSession
    bank = stage(damaged_words(texts, text))
    words = stage(dictionary.select("word").distinct())
    freq = [r["glyph"] for r in glyph_frequency(texts, text).orderBy(F.col("n").desc(), "glyph").collect()]
    mapping: dict[str, str] = {}
    certain: dict[str, bool] = {}
    rows: dict[str, tuple[str, int]] = {}

    def attempt(glyph: str) -> bool:
        winner, top, sure = _judge([tuple(r) for r in score_candidates(bank, glyph, words, mapping).collect()])
        rows[glyph], certain[glyph] = (winner, top), sure
        if sure:
            mapping[glyph] = winner
        return sure

    open_glyphs = list(freq)
    while open_glyphs:
        solved = {g for g in open_glyphs if attempt(g)}
        if not solved:
            break
        open_glyphs = [g for g in open_glyphs if g not in solved]
    for g in open_glyphs:
        if not attempt(g) and rows[g][1] > 0:
            mapping[g] = rows[g][0]
    data = [(g, f"U+{ord(g):04X}", mapping.get(g), int(rows[g][1]), not certain[g]) for g in freq]
    return spark.createDataFrame(data, "glyph string, code string, letter string, score long, uncertain boolean")


def letter_scores(flagged: DataFrame, dictionary: DataFrame, shape: str | None = None) -> DataFrame:
    """One-shot letter per (font, code): dictionary hits of blank-separated words and of their hyphen parts
    of three letters or more; ties go to the more frequent letter. ``flagged``: font, word and, if counted, n.

    ``shape``: a pattern that every dictionary word fits and that takes all letters alike; other tokens are not tried.
    """
    if "n" not in flagged.columns:
        flagged = flagged.groupBy("font", "word").agg(F.count("*").alias("n"))
    letters = F.array(*[F.lit(c) for c in LETTER_ORDER])
    edge = "^[\\p{Punct}]+|[\\p{Punct}]+$"
    pieces = flagged.select("font", "word", "n", F.explode_outer(F.split(F.lower("word"), "\\s+")).alias("token"))
    tokens = pieces.withColumn("token", F.regexp_replace("token", edge, ""))
    parts = F.regexp_extract_all("token", F.lit("[^-/]{3,}+"), F.lit(0))
    # A token that keeps another damaged glyph is in no dictionary: only the others are tried with every letter.
    may_be = F.replace("token", F.col("glyph"), F.lit("a")).rlike(shape) if shape else ~F.replace("token", F.col("glyph"), F.lit("")).rlike(PRIVATE_USE)
    base = tokens.select("font", "word", "n", F.explode_outer(F.concat(F.array("token"), parts)).alias("token"))
    open_tokens = (
        base.select("font", "n", F.explode_outer(F.array_distinct(private_chars(F.col("word")))).alias("glyph"), "token")
        .filter(F.col("glyph").isNotNull() & may_be)
        .groupBy("font", "glyph", "token").agg(F.sum("n").alias("n"))
        .select("font", code_of(F.col("glyph")).alias("code"), "glyph", "token", "n")
    )
    found = (
        open_tokens.select("font", "code", F.explode(letters).alias("letter"), "glyph", "token", "n")
        .select("font", "code", "letter", F.replace("token", F.col("glyph"), F.col("letter")).alias("token"), "n")
        .join(dictionary.select(F.col("word").alias("token")), "token", "left_semi")
        .groupBy("font", "code", "letter").agg(F.sum("n").alias("score"))
    )
    pos = F.array_position(letters, F.col("letter"))
    best = F.struct(F.col("score").alias("s"), (-pos).alias("p"))
    return found.groupBy("font", "code").agg(F.max_by("letter", best).alias("letter"), F.max("score").alias("score"))
