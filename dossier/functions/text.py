"""Text scalars: words, slugs, paragraph and sentence splits, greedy packing, cleaning.

Every function maps Columns to Columns and stays inside the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when splitting words.
WS_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
WS_CHARS += "\u2028\u2029\u202f\u205f\u3000"
WS = "(?U:[\\s\\x1c-\\x1f])"

# Chunk size limits in words.
MIN_WORDS = 50
MAX_WORDS = 500
SLUG_CHARS = 40
JUNK_CHAPTERS = ("Index",)

# Headings that never open a record.
HEADING_BLOCK_LIST = (
    "GENERAL CONSIDERATIONS",
    "DIFFERENTIAL DIAGNOSIS",
    "ESSENTIAL INQUIRIES",
    "APPROACH TO",
    "TABLE",
    "FIGURE",
    "KEY POINTS",
)

EMPTY_TEXTS = "cast(array() as array<string>)"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a let-binding for lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def words(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", F.expr(EMPTY_TEXTS)).otherwise(F.split(s, WS + "+"))


def word_count(c: Column) -> Column:
    # White space at the ends leaves an empty first or last piece; taking these off is one pass over the text, trimming before is three.
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), WS + "+"), ""))


def non_blank(texts: Column) -> Column:
    return F.filter(F.transform(texts, strip), lambda x: x != "")


def slugify(c: Column, max_len: int = SLUG_CHARS) -> Column:
    s = F.regexp_replace(strip(c), f"^[»º▸•\\-–—]+{WS}*", "")
    s = F.regexp_replace(F.lower(s), WS + "+", "_")
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}_]", "")
    s = F.btrim(F.regexp_replace(s, "_+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("unknown")).otherwise(F.substring(s, 1, max_len))


def chunk_id(prefix: str, chapter: Column, section: Column, subsection: Column, n: Column) -> Column:
    sub = F.when(blank(subsection), F.lit("main")).otherwise(slugify(subsection))
    return F.concat_ws("::", F.lit(prefix), slugify(chapter), slugify(section), sub, n.cast("string"))


def paragraphs(c: Column, separator: str = "\n{2,}") -> Column:
    return non_blank(F.split(c, separator))


def sentences(c: Column, need_capital: bool = True) -> Column:
    pattern = f"(?<=[.!?]){WS}+" + ("(?=[A-Z])" if need_capital else "")
    return non_blank(F.split(c, pattern))


def split_every(c: Column, max_words: int) -> Column:
    """Hard split into pieces of at most ``max_words`` words."""

    def pieces(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(max_words))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, max_words), " "))
        return F.when(F.size(w) == 0, F.expr(EMPTY_TEXTS)).otherwise(cut)

    return bind(words(c), pieces)


def pack_marked(segments: Column, max_words: int = MAX_WORDS) -> Column:
    """array<struct(t, cut)>: greedy packing of ordered segments; ``cut`` marks the pieces of hard split oversize ones.

    The accumulator keeps finished pieces, the open piece and its word count.
    """
    sized = F.transform(segments, lambda s: F.struct(s.alias("t"), word_count(s).alias("n")))
    start = F.struct(
        F.expr("cast(array() as array<struct<t: string, cut: boolean>>)").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n")
    )

    def piece(t: Column, cut: bool) -> Column:
        return F.struct(t.alias("t"), F.lit(cut).alias("cut"))

    def close(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["done"], F.array(piece(acc["cur"], False)))).otherwise(acc["done"])

    def state(done: Column, cur: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    def step(acc: Column, seg: Column) -> Column:
        grown = F.when(acc["n"] > 0, F.concat(acc["cur"], F.lit(" "), seg["t"])).otherwise(seg["t"])
        hard = F.transform(split_every(seg["t"], max_words), lambda t: piece(t, True))
        return (
            F.when(seg["n"] == 0, acc)
            .when(seg["n"] > max_words, state(F.concat(close(acc), hard), F.lit(""), F.lit(0)))
            .when(acc["n"] + seg["n"] > max_words, state(close(acc), seg["t"], seg["n"]))
            .otherwise(state(acc["done"], grown, acc["n"] + seg["n"]))
        )

    return F.aggregate(sized, start, step, close)


def pack(segments: Column, max_words: int = MAX_WORDS) -> Column:
    """Greedy packing of ordered segments; oversize segments are hard split."""
    return F.transform(pack_marked(segments, max_words), lambda p: p["t"])


def split_long(c: Column, max_words: int = MAX_WORDS, mode: str = "paragraph", separator: str = "\n{2,}") -> Column:
    """Pieces of a long section. ``paragraph`` packs paragraphs, ``sentence`` packs sentences."""
    parts = sentences(c) if mode == "sentence" else paragraphs(c, separator)
    return pack(parts, max_words)


def clean_chunk(c: Column, header_pattern: str) -> Column:
    """Drop the running page header and lines that hold only digits."""
    t = strip(F.regexp_replace(c, header_pattern, ""))
    kept = F.filter(F.split(t, "\n"), lambda line: ~strip(line).rlike("^\\p{Nd}+$"))
    return strip(F.array_join(kept, "\n"))


def context_prefix(chapter: Column, section: Column, subsection: Column, text: Column) -> Column:
    e = F.lit("")
    return F.concat(
        F.lit("Chapter: "), F.coalesce(chapter, e),
        F.lit(" | Section: "), F.coalesce(section, e),
        F.when(F.coalesce(subsection, e) != "", F.concat(F.lit(" | Subsection: "), subsection)).otherwise(e),
        F.lit(" | "), F.coalesce(text, e),
    )


def normalize_lines(c: Column) -> Column:
    """Undo hyphenated line breaks, collapse newlines and blanks."""
    t = F.regexp_replace(c, "([\\p{L}\\p{N}_])-\n([\\p{L}\\p{N}_])", "$1$2")
    t = F.regexp_replace(t, "\n+", "\n")
    return strip(F.regexp_replace(t, "[ \t]+", " "))


def is_record_heading(c: Column) -> Column:
    """Upper case, one to four words, no digits or .:;/ and not on the block list."""
    s = strip(c)
    ok = (s == F.upper(s)) & (s != F.lower(s)) & word_count(s).between(1, 4)
    ok = ok & ~s.rlike("[0-9.:;/]")
    for bad in HEADING_BLOCK_LIST:
        ok = ok & ~s.contains(bad)
    return ok


def name_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def first_non_empty(*cols: Column) -> Column:
    """The first column that is neither null nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """True when any phrase occurs; one pass over the text, which is evaluated once."""
    return c.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases))


def count_contained(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the lower-cased text, which is prepared once per row."""
    return bind(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: low.contains(t))))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def natural_id_key(c: Column) -> Column:
    """(prefix, trailing integer) sort key; a bad integer counts as 0."""
    has = c.contains("::")
    prefix = F.when(has, F.regexp_extract(c, "(?s)^(.*)::", 1)).otherwise(c)
    last = F.when(has, F.regexp_extract(c, "(?s)::((?:(?!::).)*)$", 1)).otherwise(F.lit(""))
    number = F.when(strip(last).rlike("^[+-]?[0-9]+$"), F.expr("0") + strip(last).try_cast("long"))
    return F.struct(prefix.alias("prefix"), F.coalesce(number, F.lit(0)).alias("n"))


def strip_fence(c: Column) -> Column:
    """The inside of a leading ``` fence without its language tag, else the trimmed text."""
    t = strip(c)
    inner = F.element_at(F.split(t, "```", -1), 2)
    inner = F.when(inner.startswith("json"), F.substr(inner, F.lit(5))).otherwise(inner)
    return F.when(t.startswith("```"), strip(inner)).otherwise(t)
