"""Finding redaction boxes: predicates, coordinate changes, unions, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from . import bands

PAGE_W, PAGE_H = 612.0, 792.0
MODES = {"annotations": ("annotations",), "drawn": ("drawn",), "all": ("annotations", "drawn")}


def annotation_hits(df: DataFrame, columns: list[str], pattern: str = "redact|blackout") -> DataFrame:
    return df.where(F.rlike(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])), F.lit(pattern)))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple(F.lit(1.0) - F.least(F.lit(1.0), x + k) for x in (c, m, y))


def is_black(r: Column, g: Column, b: Column, limit: float = 0.01) -> Column:
    return F.greatest(r, g, b) <= limit


def rect_to_pixels(x0, y0, x1, y1, dpi: int, page_w: float = PAGE_W, page_h: float = PAGE_H) -> Column:
    """Pixel rectangle, origin at the top left, rounded outwards and clipped to the page."""
    c = F.col
    return F.struct(
        F.floor(F.greatest(F.lit(0.0), c(x0)) * dpi / 72).cast("int").alias("px0"), F.floor((page_h - F.least(F.lit(page_h), c(y1))) * dpi / 72).cast("int").alias("py0"),
        F.ceil(F.least(F.lit(page_w), c(x1)) * dpi / 72).cast("int").alias("px1"), F.ceil((page_h - F.greatest(F.lit(0.0), c(y0))) * dpi / 72).cast("int").alias("py1"))


def pixels_to_rect(px0, py0, px1, py1, dpi: int, page_h: float = PAGE_H) -> Column:
    c = F.col
    return F.struct((c(px0) * 72 / F.lit(float(dpi))).alias("x0"), (F.lit(page_h) - c(py1) * 72 / F.lit(float(dpi))).alias("y0"), (c(px1) * 72 / F.lit(float(dpi))).alias("x1"), (F.lit(page_h) - c(py0) * 72 / F.lit(float(dpi))).alias("y1"))


def union_detectors(parts: list[DataFrame]) -> DataFrame:
    """All detectors' boxes, with `src`, the detector's place in the list."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)])


def gated(sources: dict[str, DataFrame], mode: str = "all", raster: bool = True) -> DataFrame:
    """The detectors that the mode lets run; the others are never planned."""
    names = [*MODES[mode], *(["raster"] if raster else [])]
    return union_detectors([sources[n] for n in names])


def dedupe_keep_first(df: DataFrame, keys: list[str], digits: int, order: list[str], kind: str = "kind") -> DataFrame:
    """The first box of those equal in kind and in coordinates rounded to so many digits."""
    w = Window.partitionBy(*keys, *[F.round(c, digits) for c in ("x0", "y0", "x1", "y1")], kind).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_counts(box: DataFrame) -> DataFrame:
    return box.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.round(F.min("x0"), 4).alias("first_x0"), F.round(F.max("x1"), 4).alias("last_x1"))


def histogram_percentiles(h: DataFrame, key: str, value: str, count: str, wanted: dict[str, float]) -> DataFrame:
    """Least value whose cumulative count reaches ceil(total * q)."""
    cum = h.withColumn("_c", F.sum(count).over(Window.partitionBy(key).orderBy(value))).withColumn("_t", F.sum(count).over(Window.partitionBy(key)))
    return cum.groupBy(key).agg(*[F.min(F.when(F.col("_c") >= F.greatest(F.lit(1), F.ceil(F.col("_t") * q)), F.col(value))).alias(k) for k, q in wanted.items()])


def two_pass(box: DataFrame, cheap: Column, costly: Column) -> DataFrame:
    """Pages that the cheap pass selects are scanned again; where that gives nothing, the cheap pass's hits stay."""
    low = box.where(cheap).groupBy("doc_id", "page_index").agg(F.count("*").alias("low"))
    high = box.join(low, ["doc_id", "page_index"], "left_semi").where(costly).groupBy("doc_id", "page_index").agg(F.count("*").alias("high"))
    return low.join(high, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.coalesce("high", "low").alias("n"), F.when(F.col("high").isNull(), "prepass").otherwise("highpass").alias("source"))


def reject_guard(box: DataFrame, keys: list[str], accepted: Column) -> DataFrame:
    c = box.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(accepted).alias("accepted"))
    return c.withColumn("status", F.when((F.col("candidates") > 0) & (F.col("accepted") == 0), "all_rejected").otherwise("ok"))


def invalid_reason(x0, y0, x1, y1, page_w: float = PAGE_W, page_h: float = PAGE_H) -> Column:
    w, h = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    return (F.when((w < 1) | (h < 1), "edge").when(w * h < 4, "area").when((F.col(x0) < 0) | (F.col(x1) > page_w) | (F.col(y0) < 0) | (F.col(y1) > page_h), "outside")
        .when(w * h / (page_w * page_h) >= 0.9, "coverage").otherwise("ok"))


def dense_boxes(box: DataFrame, gap: float = 96.0) -> DataFrame:
    """Boxes with another one of their page beside them: .4 of the lower height in common, `gap` points apart at most."""
    edges = ("x0", "y0", "x1", "y1")
    a = box.select("doc_id", "page_index", "token_idx", *[F.col(c).alias("a" + c) for c in edges])
    b = box.select("doc_id", "page_index", F.col("token_idx").alias("other"), *[F.col(c).alias("b" + c) for c in edges])
    level = overlap("ay0", "ay1", "by0", "by1") >= F.lit(0.4) * F.least(F.col("ay1") - F.col("ay0"), F.col("by1") - F.col("by0"))
    apart = F.greatest(F.col("bx0") - F.col("ax1"), F.col("ax0") - F.col("bx1"), F.lit(0.0)) <= gap
    axes = [bands.rows("ay0", "ay1", "by0", "by1"), bands.columns(F.col("ax0") - gap, F.col("ax1") + gap, "bx0", "bx1")]
    return bands.grid_join(a, b, ["doc_id", "page_index"], axes, (F.col("token_idx") != F.col("other")) & level & apart).select("doc_id", "token_idx").distinct()


def fill_bright_gaps(columns: DataFrame, keys: list[str], order: str, dark: str) -> DataFrame:
    """Adds `filled`: dark, or a single bright column between two dark ones."""
    w = Window.partitionBy(*keys).orderBy(order)
    beside = F.coalesce(F.lag(dark).over(w), F.lit(False)) & F.coalesce(F.lead(dark).over(w), F.lit(False))
    return columns.withColumn("filled", F.col(dark) | beside)


def dark_runs(columns: DataFrame, keys: list[str], order: str, dark: str) -> DataFrame:
    """Runs of dark columns: the first (a) and the one after the last (z)."""
    all_, own = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, dark).orderBy(order)
    r = columns.withColumn("isl", F.row_number().over(all_) - F.row_number().over(own)).where(F.col(dark))
    return r.groupBy(*keys, "isl").agg(F.min(order).alias("a"), (F.max(order) + 1).alias("z"))


def run_profile(runs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """How many runs a region has, the longest, and the share of its width that they cover."""
    length = F.col("z") - F.col("a")
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.max(length).alias("longest"), F.round(F.sum(length) / F.lit(float(width)), 6).alias("coverage"))


def split_factor(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the factor of their score: a region of several runs is split, which is the surer the fewer they are."""
    n = runs.withColumn("_k", F.count("*").over(Window.partitionBy(*keys)))
    return n.withColumn("factor", F.round(F.when(F.col("_k") > 1, F.lit(0.85) + F.lit(0.15) / F.col("_k")).otherwise(F.lit(1.0)), 6)).drop("_k")
