"""Sections to chunks: short-section merging, splitting, numbering, late merging, sliding windows.

Ordering work runs on narrow staged columns (keys, order, word counts); text is joined back once.
Sections carry ``seq`` as the order inside their chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import (
    JUNK_CHAPTERS,
    MAX_WORDS,
    MIN_WORDS,
    blank,
    chunk_id,
    clean_chunk,
    split_long,
    strip,
    word_count,
    words,
)
from dossier.operators.scans import compose_order, fits_one_block, prefix_scan
from dossier.session import once, stage

ESSENTIALS = "Essentials of Diagnosis"
PART_BITS = 20
WINDOW_WORDS = 200
WINDOW_STRIDE = 150


def drop_empty(sections: DataFrame) -> DataFrame:
    """Sections with neither words nor essentials text go away."""
    return sections.filter(~((F.col("word_count") == 0) & blank(F.col("essentials_text"))))


def _joined(text: Column, order: Column, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def forward_merge(sections: DataFrame, min_words: int = MIN_WORDS, keep_essentials: bool = False) -> DataFrame:
    """Prepend each short section to the next one of the same chapter and section.

    A group is a run of short sections plus the section that ends it; shortness looks at a
    section's own words only. The last section names the group; the essentials of earlier ones are
    dropped unless ``keep_essentials``.
    """
    base = sections.withColumn("text", strip(F.col("text")))
    own = F.col("word_count")
    flags = stage(base.select("chapter", "section", "seq", ((own > 0) & (own < min_words)).alias("short")))
    small = fits_one_block(flags, "seq")
    prev = prefix_scan(
        flags, ["chapter"], "seq", {"prev": ("last", F.struct("section", "short"))}, exclusive=True, single_block=small
    )
    opens = F.col("prev").isNull() | (F.col("prev.section") != F.col("section")) | ~F.col("prev.short")
    ids = prefix_scan(
        prev.withColumn("opens", opens), ["chapter"], "seq", {"gid": ("max", F.when(F.col("opens"), F.col("seq")))},
        single_block=small,
    ).select("chapter", "seq", "gid", "short")
    carried = ["source", "section", "subsection", "chapter_page_start", "has_essentials_box", "essentials_text"]
    ess = [strip(_joined(F.coalesce("essentials_text", F.lit("")), F.col("seq"), "\n\n")).alias("all_essentials")]
    out = (
        base.join(ids, ["chapter", "seq"])
        .groupBy("chapter", "gid")
        .agg(
            F.max_by(F.struct(*carried, "short"), "seq").alias("head"),
            F.max("seq").alias("seq"),
            F.count("*").alias("merged_rows"),
            F.struct(F.min("page_range.lo").alias("lo"), F.max("page_range.hi").alias("hi")).alias("page_range"),
            strip(_joined(F.col("text"), F.col("seq"), "\n\n")).alias("text"),
            F.sum("word_count").cast("int").alias("word_count"),
            *(ess if keep_essentials else []),
        )
    )
    out = out.select(
        "chapter", "seq", "page_range", "text", "word_count", "merged_rows", *(["all_essentials"] if keep_essentials else []),
        *[F.col(f"head.{c}").alias(c) for c in carried],
        F.col("head.short").alias("kept_short"),
    )
    if keep_essentials:
        out = out.withColumn("essentials_text", F.col("all_essentials")).withColumn(
            "has_essentials_box", F.col("all_essentials") != ""
        )
    return out.drop("all_essentials")


def emit_parts(
    merged: DataFrame, max_words: int = MAX_WORDS, mode: str = "paragraph", header_pattern: str | None = None
) -> DataFrame:
    """One row per chunk: the essentials row first, then the text whole or split."""
    boxed = F.col("has_essentials_box") & ~blank(F.col("essentials_text"))
    no_parts = F.expr("cast(array() as array<struct<subsection:string,text:string>>)")
    head = F.when(
        boxed, F.array(F.struct(F.lit(ESSENTIALS).alias("subsection"), strip(F.col("essentials_text")).alias("text")))
    ).otherwise(no_parts)
    pieces = (
        F.when(F.col("text") == "", F.expr("cast(array() as array<string>)"))
        .when(F.col("word_count") > max_words, split_long(F.col("text"), max_words, mode))
        .otherwise(F.array("text"))
    )
    body = F.transform(pieces, lambda t: F.struct(F.col("subsection").alias("subsection"), strip(t).alias("text")))
    rows = merged.select(
        "source", "chapter", "section", "page_range", "seq", F.posexplode(F.concat(head, body)).alias("pos", "part")
    )
    text = F.col("part.text")
    if header_pattern:
        text = clean_chunk(text, header_pattern)
    return rows.select(
        "source", "chapter", "section", F.col("part.subsection").alias("subsection"), "page_range",
        compose_order(F.col("seq"), F.col("pos"), PART_BITS).alias("ord"),
        text.alias("text"),
    ).withColumn("word_count", word_count(F.col("text")))


def number_parts(parts: DataFrame) -> DataFrame:
    """(ord, n): running number per chapter, section and subsection in emission order."""
    narrow = parts.select("chapter", "section", "subsection", "ord")
    return prefix_scan(
        narrow, ["chapter", "section", "subsection"], "ord", {"n": ("sum", F.lit(1))}, block_bits=PART_BITS + 16,
        single_block=fits_one_block(parts, "ord", PART_BITS + 16),
    ).select("chapter", "ord", "n")


def late_merge_ids(parts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(chapter, ord, head, gid): short chunks join the previous chunk of their section, and a
    leading run still under the minimum joins the next one. ``head`` starts the first-pass group."""
    narrow = parts.select("chapter", "section", "ord", "word_count")
    bits = PART_BITS + 16
    small = fits_one_block(parts, "ord", bits)
    prev = prefix_scan(
        narrow, ["chapter"], "ord", {"prev": ("last", F.col("section"))}, exclusive=True, block_bits=bits, single_block=small
    )
    opens = F.col("prev").isNull() | (F.col("prev") != F.col("section"))
    heads = opens | (F.col("word_count") >= min_words)
    grouped = stage(
        prefix_scan(
            prev.withColumn("opens", opens).withColumn("heads", heads), ["chapter"], "ord",
            {"head": ("max", F.when(F.col("heads"), F.col("ord"))), "island": ("max", F.when(F.col("opens"), F.col("ord")))},
            block_bits=bits, single_block=small,
        ).select("chapter", "ord", "word_count", "head", "island")
    )
    lead = grouped.groupBy("chapter", "island").agg(
        F.sum(F.when(F.col("head") == F.col("island"), F.col("word_count"))).alias("lead_words"),
        F.min(F.when(F.col("head") > F.col("island"), F.col("head"))).alias("head"),
    )
    pulled = lead.filter((F.col("lead_words") < min_words) & F.col("head").isNotNull()).select(
        "chapter", "head", F.col("island").alias("into")
    )
    return grouped.join(pulled, ["chapter", "head"], "left").select(
        "chapter", "ord", "head", F.coalesce("into", "head").alias("gid")
    )


def late_merge(parts: DataFrame, numbers: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Merge short chunks into neighbours; merged text may exceed the word ceiling."""
    kept = parts.filter(~F.col("chapter").isin(*JUNK_CHAPTERS) & (F.col("word_count") > 0))
    ids = late_merge_ids(kept, min_words)
    named = ["source", "section", "subsection", "n"]
    return (
        kept.join(numbers, ["chapter", "ord"])
        .join(ids, ["chapter", "ord"])
        .groupBy("chapter", "gid")
        .agg(
            F.max_by(F.struct(*named), F.when(F.col("ord") == F.col("head"), F.col("ord"))).alias("h"),
            F.struct(F.min("page_range.lo").alias("lo"), F.max("page_range.hi").alias("hi")).alias("page_range"),
            _joined(F.col("text"), F.col("ord"), "\n\n").alias("text"),
            F.sum("word_count").cast("int").alias("word_count"),
        )
        .select("chapter", F.col("gid").alias("ord"), *[F.col(f"h.{c}").alias(c) for c in named], "page_range", "text", "word_count")
    )


def structured_chunks(
    sections: DataFrame,
    prefix: str = "corpus",
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
    mode: str = "paragraph",
    header_pattern: str | None = None,
    keep_essentials: bool = False,
) -> DataFrame:
    """The whole section-to-chunk build; ids may collide when long names share a slug (see repair_ids)."""
    merged = forward_merge(drop_empty(once(sections, "word_count")), min_words, keep_essentials)
    parts = stage(emit_parts(merged, max_words, mode, header_pattern))
    chunks = late_merge(parts, number_parts(parts), min_words)
    return chunks.select(
        chunk_id(prefix, F.col("chapter"), F.col("section"), F.col("subsection"), F.col("n")).alias("chunk_id"),
        "source", "chapter", "section", "subsection", "text", "page_range", "word_count",
        F.lit("structured").alias("chunk_type"), "ord",
    )


def repair_ids(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """Second and later uses of an id get _dup2, _dup3, ..."""
    numbered = prefix_scan(
        chunks.select("chunk_id", order), ["chunk_id"], order, {"dup": ("sum", F.lit(1))}, block_bits=PART_BITS + 16
    )
    fixed = F.when(F.col("dup") > 1, F.concat("chunk_id", F.lit("_dup"), "dup")).otherwise(F.col("chunk_id"))
    return chunks.join(numbered.withColumn("unique_id", fixed).drop("dup"), ["chunk_id", order])


def sliding_chunks(sections: DataFrame, size: int = WINDOW_WORDS, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Fixed word windows over the concatenated sections, each opened by its ``[chapter / section]`` header.

    Word offsets are a distributed prefix sum; every section then emits only the slices of the
    windows it touches, so a window gathers at most ``size`` words.
    """
    full = F.concat(F.lit("["), F.col("chapter"), F.lit(" / "), F.col("section"), F.lit("]\n"), strip(F.col("text")))
    texts = sections.filter(~blank(F.col("text"))).select("seq", "chapter", "section", full.alias("full"))
    counts = stage(texts.select("seq", word_count(F.col("full")).cast("long").alias("n")))
    offsets = prefix_scan(
        counts, [], "seq", {"off": ("sum", F.col("n"))}, exclusive=True, single_block=fits_one_block(counts, "seq")
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("off") - (size - 1)) / stride)).cast("long")
    last = F.floor((F.col("off") + F.col("n") - 1) / stride).cast("long")
    slices = (
        texts.join(offsets, "seq")
        .withColumn("w", words(F.col("full")))
        .select("seq", "chapter", "section", "off", "n", "w", F.explode(F.sequence(first, last)).alias("win"))
    )
    begin = F.greatest(F.col("win") * stride - F.col("off"), F.lit(0))
    end = F.least(F.col("win") * stride + size - F.col("off"), F.col("n"))
    pieces = slices.select(
        "win", "seq", "chapter", "section", (end - begin).alias("k"),
        F.array_join(F.slice("w", (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("piece"),
    ).filter("k > 0")
    return pieces.groupBy("win").agg(
        F.format_string("baseline::%04d", F.first("win") + 1).alias("chunk_id"),
        F.min_by("chapter", "seq").alias("chapter"),
        F.min_by("section", "seq").alias("section"),
        _joined(F.col("piece"), F.col("seq"), " ").alias("text"),
        F.sum("k").alias("word_count"),
        F.lit("baseline").alias("chunk_type"),
    )


def word_count_stats(df: DataFrame, col: str = "word_count") -> DataFrame:
    c = F.col(col)
    return df.agg(
        F.count(c).alias("n"),
        F.min(c).alias("min_words"),
        F.max(c).alias("max_words"),
        F.round(F.avg(c), 4).alias("mean_words"),
        F.percentile(c, F.lit(0.5)).alias("median_words"),
        F.round(F.stddev_samp(c), 4).alias("stdev_words"),
    )


# Histogram labels with their exclusive upper bounds.
CHUNK_BUCKETS = (("<50", 50), ("50-100", 100), ("100-200", 200), ("200-300", 300), ("300-500", 501), ("500-1000", 1001), (">1000", None))
SECTION_BUCKETS = (("0", 1), ("1-49", 50), ("50-199", 200), ("200-499", 500), ("500+", None))


def word_count_histogram(df: DataFrame, buckets=CHUNK_BUCKETS, col: str = "word_count") -> DataFrame:
    """Counts per bucket; empty buckets stay with 0. One row of conditional counts, then unpivoted."""
    low, counts = 0, []
    for label, high in buckets:
        inside = F.col(col) >= low
        if high is not None:
            inside = inside & (F.col(col) < high)
        counts.append(F.count_if(inside).alias(label))
        low = high
    wide = df.agg(*counts)
    return wide.unpivot([], [F.col(f"`{b}`") for b, _ in buckets], "bucket", "n")


def section_blocks(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """The blocks of each section's full text, in order, with a heading wherever the subsection changes.

    Blank subsections keep the last one. Joining ``block`` by blank lines in ``order`` gives the text; it
    stays in rows because a section may hold a large share of the corpus.
    """
    sub = F.nullif(strip(F.coalesce("subsection", F.lit(""))), F.lit(""))
    marked = prefix_scan(
        chunks.select("section", order, "text", sub.alias("sub")), ["section"], order, {"prev": ("last", F.col("sub"))},
        exclusive=True,
    )
    changed = F.col("sub").isNotNull() & ~F.col("sub").eqNullSafe(F.col("prev"))
    heading = F.when(changed, F.concat(F.lit("\n### "), F.col("sub"), F.lit("\n\n\n"))).otherwise(F.lit(""))
    return marked.select("section", order, F.concat(heading, F.col("text")).alias("block"))
