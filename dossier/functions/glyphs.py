"""Repair of private-use glyphs and reporting of the ones that stay unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The private-use block of the basic plane.
PRIVATE_USE = "[\\uE000-\\uF8FF]"
# A word between blanks or line ends that holds one; begins at word starts only and never backtracks, so long words stay linear.
DAMAGED_WORD = "(?<![^ \\n])[^ \\n\\uE000-\\uF8FF]*+[\\uE000-\\uF8FF][^ \\n]*+"


def private_chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PRIVATE_USE})"), F.lit(1))


def code_of(ch: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))


def residual_codes(c: Column) -> Column:
    """Every remaining private-use character as U+XXXX, in text order."""
    return F.transform(private_chars(c), code_of)


def distinct_codes(c: Column) -> Column:
    """The different private-use characters as U+XXXX, sorted."""
    return F.transform(F.sort_array(F.array_distinct(private_chars(c))), code_of)


def repair(text: Column, entries: Column) -> Column:
    """Apply array<struct(glyph, replacement)> in order; null entries leave the text alone."""
    fixed = F.aggregate(entries, text, lambda t, e: F.replace(t, e["glyph"], e["replacement"]))
    return F.coalesce(fixed, text)
