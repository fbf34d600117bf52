"""Styled spans to lines, lines to sections, plus page-level checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.glyphs import distinct_codes
from dossier.functions.text import bind, strip, word_count
from dossier.operators.glyph_repair import repair_texts
from dossier.operators.scans import AT, PART, range_sort, scan_ranges
from dossier.session import stage

# Font sets of the page design.
HEADER_FOOTER_FONTS = ("f1", "f15", "f10", "f30")
BODY_FONTS = (
    "f14", "f25", "f3", "f6", "f21", "f32", "f40", "f44", "f45", "f47", "f49", "f69", "f72", "f73", "f90", "f9",
    "f12", "f43", "f46", "f53", "f64", "f68", "f126", "f142", "f145", "f147", "f152", "f177",
)
INLINE_LABEL_FONTS = ("f16", "f20", "f31", "f34")
ESSENTIALS_FONTS = ("f27",)
BULLET_FONTS = ("f8", "f17")
FIRST_CONTENT_PAGE = 21
CONTEXT_CHARS = 300


def span_role(font: Column, size: Column, text: Column) -> Column:
    """Role of a span; the first rule that fits wins."""
    s = strip(text)
    return (
        F.when(s == "", "skip")
        .when(font.isin(*HEADER_FOOTER_FONTS) & (size >= 10.0), "skip")
        .when(size >= 18.0, "chapter_header")
        .when(size <= 6.0, "superscript")
        .when((size == 11.5) & font.isin(*ESSENTIALS_FONTS), "essentials_header")
        .when((size == 9.0) & font.isin(*ESSENTIALS_FONTS), "essentials_body")
        .when((size == 11.0) & s.contains("»"), "when_to_label")
        .when((size == 11.0) & ~font.isin(*BODY_FONTS, *ESSENTIALS_FONTS), "section_heading")
        .when((size == 10.0) & ~font.isin(*HEADER_FOOTER_FONTS), "section_heading")
        .when(s.isin("•", "»") & font.isin(*BULLET_FONTS), "bullet")
        .when(size == 8.0, "reference")
        .when((size == 9.0) & font.isin(*INLINE_LABEL_FONTS), "inline_label")
        .otherwise("body")
    )


def reading_order(blocks: DataFrame, full_width: float = 0.70) -> DataFrame:
    """Number blocks of a page: full-width ones, then the left column, then the right, each by top edge."""
    b = F.col("bbox")
    column = (
        F.when(b["x1"] - b["x0"] > F.col("page_width") * full_width, 0)
        .when((b["x0"] + b["x1"]) / 2.0 < F.col("page_width") / 2.0, 1)
        .otherwise(2)
    )
    w = Window.partitionBy("page").orderBy("column_class", "bbox.y0", "block")
    return blocks.withColumn("column_class", column).withColumn("reading_pos", F.row_number().over(w))


def assemble_lines(spans: DataFrame, glyph_map: DataFrame | None = None) -> DataFrame:
    """One element per line: repaired spans joined, the first non-skip span gives role, font and size.

    ``glyph_map`` is (font, entries: array<struct(glyph, replacement)>), see repair_texts.
    """
    s = spans
    if glyph_map is not None:
        s = repair_texts(s, glyph_map, "text", "text")
    s = s.withColumn("size", F.round("size", 1)).withColumn("role", span_role(F.col("font"), F.col("size"), F.col("text")))
    s = s.filter("role <> 'skip'")
    keys = [c for c in ("chapter", "page", "block", "line") if c in s.columns]
    parts = F.array_sort(F.collect_list(F.struct("span", "text", "role", "font", "size")))
    head = F.get("p", F.lit(0))
    return (
        s.groupBy(*keys)
        .agg(parts.alias("p"))
        .select(
            *keys, head["role"].alias("role"), head["font"].alias("font"), head["size"].alias("size"),
            strip(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"),
        )
        .filter("text <> ''")
        .withColumn("residual", distinct_codes(F.col("text")))
    )


def chapter_ranges(outline: DataFrame, last_page: Column, first_content_page: int = FIRST_CONTENT_PAGE) -> DataFrame:
    """(title, start, end) of the top-level entries: a chapter ends where the next begins, end exclusive.

    The outline is one row per chapter heading of a book; ``book`` keeps several books apart.
    """
    w = Window.partitionBy("book").orderBy("start", "title")
    ends = outline.withColumn("end", F.coalesce(F.lead("start").over(w), last_page + 1))
    return ends.filter(F.col("start") >= first_content_page)


def clamp_ranges(ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Keep ranges that overlap pages lo..hi and cut them to it."""
    return (
        ranges.filter((F.col("start") <= hi) & (F.col("end") > lo))
        .withColumn("start", F.greatest("start", F.lit(lo)))
        .withColumn("end", F.least("end", F.lit(hi + 1)))
    )


def track_sections(elements: DataFrame) -> DataFrame:
    """Place every element in its section.

    ``elements``: chapter, chapter_start, ord (anything that sorts), page, role, size, text. Adds seg, section, subsection,
    page_start as they stand after the element, ``*_before`` as they stood before it, and the count
    of body lines before it.
    """
    is_heading = F.col("role") == "section_heading"
    top = is_heading & (F.col("size") >= 11.0)
    label = F.col("role") == "when_to_label"
    content = F.col("role").isin("body", "inline_label", "essentials_body")
    body = F.col("role").isin("body", "inline_label")
    flagged = elements.withColumn("top", top).withColumn("bound", is_heading | label).withColumn("label", label)
    flagged = flagged.withColumn("is_body", body)
    places = {"_content": ("max", F.when(content, F.col("ord"))), "_bound": ("max", F.when(F.col("bound"), F.col("ord")))}
    seen = scan_ranges(range_sort(flagged, ["chapter"], ["ord"]), ["chapter"], places, exclusive=True)
    # A minor heading right after another heading keeps the page on which the open section began.
    resets = F.col("top") | F.col("label") | (
        F.col("bound") & F.col("_content").isNotNull() & F.coalesce(F.col("_content") > F.col("_bound"), F.lit(True))
    )
    own = {
        "seg": F.col("bound").cast("int"),
        "section": F.when(F.col("top"), F.col("text")),
        "subsection": F.when(F.col("top"), F.lit("")).when(F.col("bound"), F.col("text")),
        "page_start": F.when(F.col("resets"), F.col("page")),
        "bodies": F.col("is_body").cast("int"),
    }
    ops = {"seg": "sum", "section": "last", "subsection": "last", "page_start": "last", "bodies": "sum"}
    marked = stage(seen.withColumn("resets", resets).drop("_content", "_bound"))
    tracked = scan_ranges(marked, ["chapter"], {f"{k}_before": (op, own[k]) for k, op in ops.items()}, exclusive=True).drop(PART, AT)
    defaults = {"section": F.col("chapter"), "subsection": F.lit(""), "page_start": F.col("chapter_start")}
    for k, op in ops.items():
        if op == "last":
            tracked = tracked.withColumn(f"{k}_before", F.coalesce(f"{k}_before", defaults[k]))
        before = F.col(f"{k}_before")
        tracked = tracked.withColumn(k, before + own[k] if op == "sum" else F.coalesce(own[k], before))
    return tracked


def build_sections(tracked: DataFrame, ends: DataFrame, source: str = "corpus") -> DataFrame:
    """Sections with body and essentials text. ``ends``: chapter, last_page."""

    def lines(cond: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text"))))
        return strip(F.array_join(F.transform(rows, lambda r: r["text"]), " "))

    heads = tracked.filter("bound").select("chapter", (F.col("seg") - 1).alias("seg"), F.col("page").alias("next_page"))
    grouped = (
        tracked.filter(F.col("role").isin("body", "inline_label", "essentials_body"))
        .groupBy("chapter", "seg")
        .agg(
            F.min("ord").alias("seq"),
            F.first("chapter_start").alias("chapter_page_start"),
            F.first("section").alias("section"),
            F.first("subsection").alias("subsection"),
            F.first("page_start").alias("lo"),
            lines(F.col("is_body")).alias("text"),
            lines(F.col("role") == "essentials_body").alias("essentials_text"),
        )
        .join(heads, ["chapter", "seg"], "left")
        .join(ends, "chapter")
    )
    return grouped.select(
        F.lit(source).alias("source"), "chapter", "chapter_page_start", "seq", "section", "subsection", "text",
        F.struct(F.col("lo"), F.coalesce("next_page", "last_page").alias("hi")).alias("page_range"),
        word_count(F.col("text")).alias("word_count"),
        (F.col("essentials_text") != "").alias("has_essentials_box"),
        "essentials_text",
    )


def flag_unknown_glyphs(tracked: DataFrame, lookback: int = 3, limit: int = CONTEXT_CHARS) -> DataFrame:
    """Elements with unknown glyphs and the previous body lines of their open section as context.

    Body lines are numbered, so the context is an equi join on three line numbers, not a window.
    """
    hits = tracked.filter(F.size("residual") > 0).select(
        "chapter", "ord", "page", "font", F.col("text").alias("word"), "residual",
        F.col("section_before").alias("section"), F.col("seg_before").alias("seg"), "bodies_before",
    )
    wanted = hits.select(
        "chapter", "seg", F.col("ord").alias("hit"),
        F.explode(F.sequence(F.col("bodies_before") - (lookback - 1), F.col("bodies_before"))).alias("bodies"),
    )
    lines = tracked.filter("is_body").select("chapter", "seg", "bodies", "text")
    context = (
        wanted.join(lines, ["chapter", "seg", "bodies"])
        .groupBy("chapter", F.col("hit").alias("ord"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bodies", "text"))), lambda r: r["text"]), " ").alias("before"))
    )
    snippet = strip(F.concat(F.coalesce("before", F.lit("")), F.lit(" [HERE] "), "word"))
    return hits.join(context, ["chapter", "ord"], "left").select(
        "chapter", "section", "page", "font", "word", F.col("residual").alias("residual_chars"),
        F.substring(snippet, 1, limit).alias("context"), "ord",
    )


def pages_without_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("page").agg(F.max(F.length(strip(F.coalesce("text", F.lit(""))))).alias("n")).filter("n = 0").select("page")


def record_lines(lines: Column, is_heading) -> Column:
    """array<struct(heading, body)> of one document's lines: a heading opens a record, the following
    lines are joined by blanks; lines before the first heading and headings without lines go away.

    Headings are found once and records are slices between them, so the work grows with the lines.
    """

    def cut(kept: Column) -> Column:
        places = F.filter(
            F.transform(kept, lambda line, i: F.when(is_heading(line), i + 1)), lambda p: p.isNotNull()
        )

        def slices(at: Column) -> Column:
            return F.transform(
                at,
                lambda p, k: F.struct(
                    F.element_at(kept, p).alias("heading"),
                    F.array_join(F.slice(kept, p + 1, F.coalesce(F.get(at, k + 1), F.size(kept) + 1) - p - 1), " ").alias("body"),
                ),
            )

        return F.filter(bind(places, slices), lambda r: r["body"] != "")

    return bind(F.filter(F.transform(lines, strip), lambda line: line != ""), cut)
