"""Glyph widths of the core fonts and text width columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Helvetica advance widths of the printable ASCII characters (space to tilde), in 1/1000 of the font size.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
FALLBACK = 600
COURIER = [600] * len(HELVETICA)


def char_units(char: Column, table: list[int] | None = None) -> Column:
    """Units of one character; null for a character that the table lacks."""
    return F.get(F.array(*[F.lit(x) for x in table or HELVETICA]), F.ascii(char) - 32)


def width_units(text: Column, table: list[int] | None = None) -> Column:
    """Sum of the units of a text; FALLBACK for a character that the table lacks."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(F.coalesce(char_units(c, table), F.lit(FALLBACK))))


def strict_units(text: Column, table: list[int] | None = None) -> Column:
    """Sum of the units of a text; null if the table lacks one of its characters."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(char_units(c, table)))


def project(units: Column, size, n_chars, n_spaces=0, h_scale=100.0, char_spacing=0.0, word_spacing=0.0) -> Column:
    """Width in points: units scaled by size and horizontal scale (0.01 at least), and spacing between and within words."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return units * lit(size) / 1000 * F.greatest(lit(h_scale) / 100, F.lit(0.01)) + lit(char_spacing) * F.greatest(lit(n_chars) - 1, F.lit(0)) + lit(word_spacing) * lit(n_spaces)


def fallback_width(size, n_chars, scale=1.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.lit(1.0), F.lit(0.6) * lit(size) * lit(n_chars) * lit(scale))
