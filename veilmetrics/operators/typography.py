"""Typesetting rules and font tables as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newline_delta(leading: Column, size: Column) -> Column:
    """How far a new line goes: minus the leading if that is more than a hundredth, else minus 1.2 sizes."""
    return F.when(F.abs(leading) > 0.01, -leading).otherwise(F.lit(-1.2) * size)


def simple_width(n_chars: Column, size: Column) -> Column:
    return F.lit(0.6) * size * n_chars


def run_width(glyphs: Column, n_chars: Column, char_spacing: Column, word_spacing: Column, spaces: Column, adjustments: Column) -> Column:
    """Glyphs, spacing between characters and at spaces, and adjustments; .001 at least."""
    return F.greatest(F.lit(0.001), glyphs + (n_chars - 1) * char_spacing + word_spacing * spaces + adjustments)


def normalised_advances(advances: Column, width: Column, n: Column | None = None) -> Column:
    """Advances scaled to a width; uniform if their number isn't n, one is negative or null, or they add up to nothing."""
    total = F.aggregate(advances, F.lit(0.0), lambda s, x: s + x)
    count = F.size(advances) if n is None else n
    bad = F.exists(advances, lambda x: x.isNull() | (x < 0)) | (F.size(advances) != count) | ~(total > 0)
    return F.when(bad, F.transform(F.sequence(F.lit(1), count), lambda _: width / count)).otherwise(F.transform(advances, lambda x: x * width / total))


def width_source(explicit: Column, standard: Column) -> Column:
    """The file's own widths before those of a core font."""
    return F.when(explicit, "explicit").when(standard, "standard14").otherwise("none")


def boundary(text: Column, size: Column, space_units: float = 278.0) -> Column:
    """struct(leading, trailing, lead_pt, trail_pt): spaces at a run's ends and what they advance, by which its inner edges move."""
    lead, trail = (F.length(text) - F.length(f(text)) for f in (F.ltrim, F.rtrim))
    pt = lambda n: F.round(n * F.lit(space_units) * size / F.lit(1000.0), 4)
    return F.struct(lead.cast("long").alias("leading"), trail.cast("long").alias("trailing"), pt(lead).alias("lead_pt"), pt(trail).alias("trail_pt"))


def font_counts(occurrences: DataFrame, family: str, variant: str) -> DataFrame:
    return occurrences.groupBy(F.col(family).alias("family"), F.col(variant).alias("variant")).agg(F.count("*").alias("n"))


def distinct_fonts(occurrences: DataFrame, family: str, variant: str) -> DataFrame:
    return occurrences.select(F.col(family).alias("family"), F.col(variant).alias("variant")).distinct()


def inventory_rollup(fonts: DataFrame, file: str, source: str, flags: dict[str, Column]) -> DataFrame:
    """Fonts and flags for each file and source, each file, and the corpus; a file's or source's total is `all`, a null is `unknown`."""
    d = fonts.withColumns({"_f": F.coalesce(F.col(file), F.lit("unknown")), "_s": F.coalesce(F.col(source), F.lit("unknown"))})
    r = d.rollup("_f", "_s").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    return r.select(F.coalesce("_f", F.lit("all")).alias("file"), F.coalesce("_s", F.lit("all")).alias("source"), "n", *flags)


def complete_files(fonts: DataFrame, file: str, has_source: Column) -> DataFrame:
    """How many files have a source for all their fonts, and how many files there are."""
    return fonts.groupBy(file).agg(F.bool_and(has_source).alias("ok")).agg(F.count_if("ok").alias("complete"), F.count("*").alias("files"))


def reason_codes(rules: dict[str, Column]) -> Column:
    """The codes whose rule holds, in order, as an array to explode."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def anchor_codes(tolerance: float = 1.0) -> dict[str, Column]:
    """What an anchor decision says about a box, from the columns that `measure.edges` gives."""
    c = F.col
    box, gap_l, gap_r = c("box_x1") - c("box_x0"), c("box_x0") - c("left_edge"), c("right_edge") - c("box_x1")
    two = c("left_edge").isNotNull() & c("right_edge").isNotNull()
    return {
        "no_left": c("left_edge").isNull(), "no_right": c("right_edge").isNull(), "box_beside": c("prev_box_x1").isNotNull() | c("next_box_x0").isNotNull(), "wide_gap": c("target_width") > 60,
        "selected_two_sided": c("mode") == "two_sided", "selected_left_only": c("mode") == "left_only", "selected_right_only": c("mode") == "right_only", "rejected_unresolved": c("mode") == "unresolved",
        "edges_inverted": two & (c("right_edge") <= c("left_edge")), "width_from_box": ~two | (c("right_edge") <= c("left_edge")), "width_from_edges": two & (c("right_edge") > c("left_edge")),
        "left_gap_negative": gap_l < 0, "right_gap_negative": gap_r < 0, "left_gap_wide": gap_l > 18, "right_gap_wide": gap_r > 18, "seed_left": gap_l <= gap_r, "seed_right": gap_l > gap_r,
        "previous_box_adjacent": c("box_x0") - c("prev_box_x1") <= 18, "next_box_adjacent": c("next_box_x0") - c("box_x1") <= 18, "span_wider_than_box": c("target_width") > box + tolerance, "span_narrower_than_box": c("target_width") < box - tolerance,
        "box_narrow": box < 20, "box_wide": box >= 100, "blocked_left": c("left_edge").isNull() & c("prev_box_x1").isNotNull(), "blocked_right": c("right_edge").isNull() & c("next_box_x0").isNotNull()}

