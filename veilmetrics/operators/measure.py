"""Measuring, scoring, ranking and deduplicating the strings that could fit a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.widths import project, strict_units, width_units

PENALTY_PT = 2.75
MAX_RANK = 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by the keys over all the session's shuffle partitions: small rows that make much work each, which adaptive execution would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def edges(tok: DataFrame, space: int = 278) -> DataFrame:
    """One row per box: mode, usable edges, target width and the boxes beside it on its line.

    The nearest visible words on both sides are the anchors; a space's width belongs to the anchor.
    """
    w = Window.partitionBy("doc_id", "line").orderBy("token_idx")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    seen, box = ~F.col("is_box"), F.col("is_box")
    gap = F.col("font_size") * F.lit(float(space)) / F.lit(1000.0)
    t = tok.withColumns({
        "_l": F.last(F.when(seen, F.col("x1")), True).over(before), "_r": F.first(F.when(seen, F.col("x0")), True).over(after),
        "prev_box_x1": F.last(F.when(box, F.col("x1") + 0.5), True).over(before), "next_box_x0": F.first(F.when(box, F.col("x0") - 0.5), True).over(after)})
    t = t.where("is_box").withColumns({"left_edge": F.col("_l") + gap, "right_edge": F.col("_r") - gap})
    mode = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "two_sided").when(F.col("_l").isNotNull(), "left_only").when(F.col("_r").isNotNull(), "right_only").otherwise("unresolved")
    width = (F.col("x1") + 0.5) - (F.col("x0") - 0.5)  # of the box's own edges: x1 - x0 + 1 rounds differently
    return t.select("doc_id", "page_index", "line", "token_idx", F.col("token").alias("target"), "units", "font_size", (F.col("x0") - 0.5).alias("box_x0"), (F.col("x1") + 0.5).alias("box_x1"), "prev_box_x1", "next_box_x0", mode.alias("mode"), "left_edge", "right_edge",
        F.when(F.col("right_edge") > F.col("left_edge"), F.col("right_edge") - F.col("left_edge")).otherwise(width).alias("target_width"))


def predicted_left(width: Column) -> Column:
    return F.when(F.col("mode").isin("two_sided", "left_only"), F.col("left_edge")).when(F.col("mode") == "right_only", F.col("right_edge") - width)


def predicted_right(width: Column) -> Column:
    return F.when(F.col("mode").isin("two_sided", "left_only"), F.col("left_edge") + width).when(F.col("mode") == "right_only", F.col("right_edge"))


def error_pt(width: Column) -> Column:
    """Distance of the predicted edge from the one that is known; null if unresolved."""
    right, left = predicted_right(width), predicted_left(width)
    return F.when(F.col("mode") == "two_sided", F.abs(right - F.col("right_edge"))).when(F.col("mode") == "left_only", F.abs(right - F.col("box_x1"))).when(F.col("mode") == "right_only", F.abs(left - F.col("box_x0")))


def overlaps_neighbour(width: Column, tolerance: Column) -> Column:
    """The candidate would run into the box before or after it on the line by more than the tolerance."""
    return F.coalesce(F.col("prev_box_x1") - predicted_left(width) > tolerance, F.lit(False)) | F.coalesce(predicted_right(width) - F.col("next_box_x0") > tolerance, F.lit(False))


def dictionary(tok: DataFrame, pattern: str = "^[A-Za-z]{4,20}$") -> DataFrame:
    """text and units of each distinct word, one spelling for each upper-case form."""
    once = tok.select("token").where(F.rlike("token", F.lit(pattern))).distinct()  # a least text is found by sorting: of distinct words alone
    return once.groupBy(F.upper("token").alias("norm")).agg(F.min("token").alias("text")).withColumn("units", width_units(F.col("text")))


def ranked_candidates(rows: DataFrame, words: DataFrame, max_error: float = 0.5, top: int = MAX_RANK) -> DataFrame:
    """The best `top` words of each resolved row with an error of max_error points at most.

    Words are grouped by their integer width first. A word of 20 letters has some 20,000 possible widths, so the groups, each
    with its `top` best words, are a relation of bounded size and are broadcast; a row meets the few groups in its band.
    """
    order = Window.partitionBy("units").orderBy(F.length("text").desc(), "norm")
    best = words.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    groups = best.groupBy("units").agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "text", "norm"))).alias("ws"), F.count("*").alias("cnt"))
    fixed = F.when(F.col("mode") == "two_sided", F.col("right_edge") - F.col("left_edge")).when(F.col("mode") == "left_only", F.col("box_x1") - F.col("left_edge")).when(F.col("mode") == "right_only", F.col("right_edge") - F.col("box_x0"))
    r = rows.where("mode <> 'unresolved'").drop("units").withColumn("_t", fixed * 1000 / F.col("font_size")).withColumn("_b", F.lit(max_error * 1000 + 0.01) / F.col("font_size"))
    key = ["doc_id", "token_idx"]
    # rows alone are shuffled, once: what is joined and ranked below stays where its row is, and texts come in when groups are chosen
    r = r.where(F.col("_t") + F.col("_b") >= 0).select(*key, "mode", "target", "font_size", "left_edge", "right_edge", "box_x0", "box_x1", "prev_box_x1", "next_box_x0", "_t", "_b")
    r = spread(r, *key)
    r = r.withColumn("units", F.explode(F.sequence(F.greatest(F.ceil(F.col("_t") - F.col("_b")), F.lit(0)).cast("long"), F.floor(F.col("_t") + F.col("_b")).cast("long"))))
    width = F.col("units") * F.col("font_size") / F.lit(1000.0)
    met = r.join(F.broadcast(groups.drop("ws")), "units").withColumn("error_pt", F.round(error_pt(width), 4)).where(F.col("error_pt") <= max_error)
    met = met.where(~overlaps_neighbour(width, F.lit(1.0)))
    near = Window.partitionBy(*key).orderBy(F.round(F.col("error_pt") * 10_000).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.coalesce(F.sum("cnt").over(near), F.lit(0))).where(F.col("_before") < top)
    each = met.join(F.broadcast(groups.drop("cnt")), "units").select(*key, "mode", "target", "units", "error_pt", F.inline("ws"))
    final = Window.partitionBy(*key).orderBy("error_pt", F.length("text").desc(), "norm")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select(*key, "mode", "target", "rank", "text", "norm", "units", "error_pt")


def penalised(error: Column, family: Column, tolerance: Column) -> tuple[Column, Column]:
    """(adjusted, normalised) error: a template that isn't canonical costs PENALTY_PT."""
    adjusted = error + F.when(family == "canonical", F.lit(0.0)).otherwise(F.lit(PENALTY_PT))
    return adjusted, adjusted / F.greatest(tolerance, F.lit(1.0))


def dedupe_ranked(df: DataFrame, keys: list[str], norm: str = "norm", rank: str = "rank") -> DataFrame:
    """Keeps the best-ranked row of each normalised text and closes the ranks."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, norm).orderBy(rank))).where("_k = 1").drop("_k")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(rank)))


__all__ = ["dedupe_ranked", "dictionary", "edges", "error_pt", "overlaps_neighbour", "penalised", "predicted_left", "predicted_right", "project", "ranked_candidates", "spread", "strict_units"]
