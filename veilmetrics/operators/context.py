"""The text around a box: band joins, anchors, phrases, lines, neighbours.

Joins by coordinates are grid joins (`bands`), others are equal in document and line; none becomes a cross product.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap, overlap_len, quantise
from . import bands

BAND_PT, LINE_WINDOW_PT, LARGE_OVERLAP_PT, NO_GAP = 2.0, 18.0, 20.0, 100_000


def line_bucket(y0, y1) -> Column:
    return F.round((F.col(y0) + F.col(y1)) / 4).cast("long")


def band_join(box: DataFrame, run: DataFrame) -> DataFrame:
    """Words of the box's page that overlap its band of BAND_PT, or whose centres lie LINE_WINDOW_PT apart at most."""
    b = box.select("doc_id", "page_index", "token_idx", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    r = run.select("doc_id", "page_index", F.col("token_idx").alias("rt"), "token", "x0", "x1", "y0", "y1")
    middle = (F.col("by0") + F.col("by1")) / 2
    near = (overlap("y0", "y1", F.col("by0") - BAND_PT, F.col("by1") + BAND_PT) > 0) | (F.abs((F.col("y0") + F.col("y1")) / 2 - middle) <= LINE_WINDOW_PT)
    reach = bands.rows(F.least(F.col("by0") - BAND_PT, middle - LINE_WINDOW_PT), F.greatest(F.col("by1") + BAND_PT, middle + LINE_WINDOW_PT), "y0", "y1")
    return bands.grid_join(b, r, ["doc_id", "page_index"], [reach], near).withColumn("bucket", line_bucket("y0", "y1"))


def line_anchors(joined: DataFrame) -> DataFrame:
    """For each box and line: the rightmost word that starts before the box, the leftmost that ends after it, and the overlap."""
    hit = F.struct("x0", "x1", F.col("rt").alias("t"))
    return joined.groupBy("doc_id", "token_idx", "bucket").agg(
        F.max(F.when(F.col("x0") < F.col("bx0"), hit)).alias("bef"), F.min(F.when(F.col("x1") > F.col("bx1"), hit)).alias("aft"),
        F.sum(overlap_len("x0", "x1", "bx0", "bx1")).alias("ov"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("lcy"), F.first("bx0").alias("bx0"), F.first("bx1").alias("bx1"),
        F.first((F.col("by0") + F.col("by1")) / 2).alias("bcy"), F.count("*").alias("n"))


def best_line(lines: DataFrame) -> DataFrame:
    """The line of least (context rank, vertical distance, gap before, gap after)."""
    both, before = F.col("bef").isNotNull() & F.col("aft").isNotNull(), F.col("bef").isNotNull()
    wide = F.col("ov") > LARGE_OVERLAP_PT
    ranked = lines.where((F.col("bef").isNotNull() | F.col("aft").isNotNull()) & ~(wide & F.col("bef").isNull())).withColumns({
        "context_rank": F.when(both, F.when(wide, 2).otherwise(0)).when(before, 1).otherwise(2),
        "y_rank": F.round(F.abs(F.col("lcy") - F.col("bcy")) * 100).cast("long"),
        "before_gap": F.coalesce(F.round(F.greatest(F.lit(0.0), F.col("bx0") - F.col("bef.x1")) * 100), F.lit(float(NO_GAP))).cast("long"),
        "after_gap": F.coalesce(F.round(F.greatest(F.lit(0.0), F.col("aft.x0") - F.col("bx1")) * 100), F.lit(float(NO_GAP))).cast("long")})
    order = F.struct("context_rank", "y_rank", "before_gap", "after_gap", "bucket")
    best = ranked.groupBy("doc_id", "token_idx").agg(F.min_by(F.struct(*[c for c in ranked.columns if c not in ("doc_id", "token_idx")]), order).alias("_best"))
    return best.select("doc_id", "token_idx", "_best.*")


def phrases(joined: DataFrame, best: DataFrame, reach: float = 30.0) -> DataFrame:
    """before and after of each box: the anchors of its best line, each with the next word outward if that is `reach` points away at most.

    joined: band_join; best: best_line of its line_anchors. An anchor that is missing gives an empty phrase.
    """
    line = joined.groupBy("doc_id", "token_idx", "bucket").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "rt", "token"))).alias("ws"))
    d = best.select("doc_id", "token_idx", "bucket", F.col("bef.t").alias("bt"), F.col("aft.t").alias("at")).join(line, ["doc_id", "token_idx", "bucket"])
    place = lambda t: F.array_position(F.transform("ws", lambda x: x["rt"]), F.col(t)).cast("int") - 1
    d = d.withColumns({"_b": F.when(F.col("bt").isNotNull(), place("bt")), "_a": F.when(F.col("at").isNotNull(), place("at"))})
    word = lambda i: F.when(i >= 0, F.get("ws", i))
    b0, b1, a0, a1 = word(F.col("_b")), word(F.col("_b") - 1), word(F.col("_a")), word(F.col("_a") + 1)
    before = F.concat_ws(" ", F.when(b0["x0"] - b1["x1"] <= reach, b1["token"]), b0["token"])
    after = F.concat_ws(" ", a0["token"], F.when(a1["x0"] - a0["x1"] <= reach, a1["token"]))
    return d.select("doc_id", "token_idx", before.alias("before"), after.alias("after"))


def line_cluster(run: DataFrame, reach: float = 18.0) -> DataFrame:
    ln = run.groupBy("doc_id", "page_index", "line").agg(F.count("*").alias("n"), F.max("y1").alias("y"))
    w = Window.partitionBy("doc_id", "page_index").orderBy("line")
    return ln.select("doc_id", "page_index", "line", "n", F.coalesce(F.lag("y").over(w) - F.col("y") <= reach, F.lit(False)).alias("joins_above"), F.coalesce(F.col("y") - F.lead("y").over(w) <= reach, F.lit(False)).alias("joins_below"))


def context_spans(joined: DataFrame, limit: int = 48) -> DataFrame:
    role = F.when(F.col("x1") <= F.col("bx0") + 0.5, "left").when(F.col("x0") >= F.col("bx1") - 0.5, "right").otherwise("center")
    s = joined.select("doc_id", "token_idx", role.alias("role"), F.round("x0", 1).alias("x0"), F.round("x1", 1).alias("x1"), "bucket", "rt", "token").distinct()
    w = Window.partitionBy("doc_id", "token_idx").orderBy(F.desc("bucket"), "x0", "x1", "rt")
    return s.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def attach_text(box: DataFrame, tok: DataFrame) -> DataFrame:
    """Text under each box, by rectangles of one page that overlap; boxes without any stay."""
    b = box.select("doc_id", "page_index", "token_idx", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    t = tok.select("doc_id", "page_index", F.col("token_idx").alias("rt"), "token", "x0", "y0", "x1", "y1")
    under = (overlap("x0", "x1", "bx0", "bx1") > 0) & (overlap("y0", "y1", "by0", "by1") > 0)
    axes = [bands.rows("by0", "by1", "y0", "y1"), bands.columns("bx0", "bx1", "x0", "x1")]
    hits = bands.grid_join(b, t, ["doc_id", "page_index"], axes, under).groupBy("doc_id", "token_idx").agg(F.count("*").alias("hits"), F.min("token").alias("first_text"))
    return box.select("doc_id", "token_idx").join(hits, ["doc_id", "token_idx"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def greedy_lines(run: DataFrame, baseline: float = 3.0, gap: float = 250.0) -> DataFrame:
    """Adds `bucket`: in order of (y1, x0) a word joins the last line if baseline and gap allow, or else begins one."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("y1", "x0")
    joins = (F.abs(F.col("y1") - F.lag("y1").over(w)) <= baseline) & (F.col("x0") - F.lag("x1").over(w) <= gap)
    fresh = run.withColumn("_f", F.when(joins, 0).otherwise(1))
    return fresh.withColumn("bucket", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def ranked_lines(box: DataFrame, run: DataFrame) -> DataFrame:
    """Lines (as greedy_lines builds them) that a box overlaps or whose baseline is 3 points from its own at most, by overlap and distance."""
    ln = greedy_lines(run).groupBy("doc_id", "page_index", "bucket").agg(F.max("y1").alias("baseline"), F.min("y0").alias("ly0"), F.max("y1").alias("ly1"))
    b = box.select("doc_id", "page_index", "token_idx", "y0", "y1")
    near = (overlap("y0", "y1", "ly0", "ly1") > 0) | (F.abs(F.col("baseline") - F.col("y1")) <= 3)
    j = bands.grid_join(b, ln, ["doc_id", "page_index"], [bands.rows("y0", F.col("y1") + 3, F.col("ly0"), F.col("ly1") + 3)], near)
    j = j.withColumns({"ov": overlap_len("y0", "y1", "ly0", "ly1"), "delta": F.abs(F.col("baseline") - F.col("y1"))})
    w = Window.partitionBy("doc_id", "token_idx").orderBy(quantise("ov").desc(), quantise("delta"), "bucket")
    return j.withColumn("rank", F.row_number().over(w))


def side_relations(box: DataFrame, run: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """How each word of the line stands to the box, as a left anchor: 0 outside, 1 small overlap, 2 deep overlap, 3 other side."""
    b = box.select("doc_id", "line", "token_idx", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    j = b.join(run.select("doc_id", "line", F.col("token_idx").alias("rt"), "x0", "x1"), ["doc_id", "line"])
    rel = F.when(F.col("x1") <= F.col("bx0"), 0).when(F.col("x0") < F.col("bx0"), F.when(F.col("x1") - F.col("bx0") <= tolerance, 1).otherwise(2)).when(F.col("x0") < F.col("bx1"), 2).otherwise(3)
    return j.withColumns({"relation": rel, "gap": F.abs(F.col("x1") - F.col("bx0")), "depth": F.greatest(F.lit(0.0), F.col("x1") - F.col("bx0")), "w": F.col("x1") - F.col("x0")})


def ranked_runs(relations: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "token_idx").orderBy("relation", quantise("gap"), quantise("depth"), quantise("w"), "rt")
    return relations.where("relation < 2").withColumn("rank", F.row_number().over(w))


def join_space(before: Column, after: Column, gap: Column) -> Column:
    """A blank where two runs' texts meet as words, if they are apart by .25 points at least and have none there; else nothing."""
    last, first = F.substring(before, -1, 1), F.substring(after, 1, 1)
    word = lambda c, more: F.rlike(c, F.lit(r"^[\p{L}\p{N}" + more + "]$"))
    return F.when(word(last, ",") & word(first, "(") & (gap >= 0.25), " ").otherwise("")


def joined_runs(run: DataFrame, profile: tuple[str, ...] = ("font_size",), baseline: float = 3.0, least: float = -0.5, most: float = 18.0) -> DataFrame:
    """Neighbours of a line joined to one text: doc_id, page_index, first (token_idx), n, text, x0 and x1.

    Neighbours follow each other in a line as greedy_lines builds it, have the same width profile and the same baseline, and
    are `least` to `most` points apart.
    """
    w = Window.partitionBy("doc_id", "page_index", "bucket").orderBy("x0", "x1", "token_idx")
    gap = F.col("x0") - F.lag("x1").over(w)
    same = (F.abs(F.col("y1") - F.lag("y1").over(w)) <= baseline) & gap.between(least, most)
    for c in profile:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    r = greedy_lines(run).withColumn("_f", F.when(same, 0).otherwise(1)).withColumn("_sep", F.when(F.col("_f") == 0, join_space(F.lag("token").over(w), F.col("token"), gap)).otherwise(""))
    r = r.withColumn("_island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.array_sort(F.collect_list(F.struct("x0", "x1", "token_idx", F.concat("_sep", "token").alias("t"))))
    d = r.groupBy("doc_id", "page_index", "bucket", "_island").agg(each.alias("_a"), F.max("x1").alias("x1"))
    return d.select("doc_id", "page_index", F.get("_a", F.lit(0))["token_idx"].alias("first"), F.size("_a").cast("long").alias("n"), F.array_join(F.transform("_a", lambda x: x["t"]), "").alias("text"), F.get("_a", F.lit(0))["x0"].alias("x0"), "x1")


def anchor_pairs(box: DataFrame, run: DataFrame) -> DataFrame:
    """Left and right anchors of each box on its line, all paired."""
    b = box.select("doc_id", "line", "token_idx", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    j = b.join(run.select("doc_id", "line", F.col("token_idx").alias("rt"), "x0", "x1"), ["doc_id", "line"])
    left = j.where("x1 <= bx0").select("doc_id", "token_idx", F.col("rt").alias("left_rt"), (F.col("bx0") - F.col("x1")).alias("lg"))
    right = j.where("x0 >= bx1").select("doc_id", "token_idx", F.col("rt").alias("right_rt"), (F.col("x0") - F.col("bx1")).alias("rg"))
    return left.join(right, ["doc_id", "token_idx"]).withColumns({"gap_sum": quantise(F.col("lg") + F.col("rg")), "gap_max": quantise(F.greatest("lg", "rg"))})


def best_pair(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "token_idx").orderBy("gap_sum", "gap_max", F.desc("left_rt"), "right_rt")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def row_bias(run: DataFrame) -> DataFrame:
    """Per line, the median residual of the word gaps and the 75th percentile of its deviations, both by floor index."""
    w = Window.partitionBy("doc_id", "line").orderBy("token_idx")
    res = run.withColumn("res", F.col("x0") - F.lag("x1").over(w) - F.col("font_size") * F.lit(0.278)).where("res is not null")
    s = res.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.round("res", 4) + F.lit(0.0))).alias("a"))
    s = s.withColumn("bias", F.get("a", F.floor(F.size("a") * 0.5).cast("int")))
    dev = F.array_sort(F.transform("a", lambda x: F.round(F.abs(x - F.col("bias")), 4)))
    return s.select("doc_id", "line", "bias", F.least(F.lit(8.0), F.greatest(F.lit(3.5), F.get(dev, F.floor(F.size("a") * 0.75).cast("int")))).alias("tolerance"))


def neighbours(box: DataFrame) -> DataFrame:
    p = Window.partitionBy("doc_id", "line")
    w = p.orderBy("x0", "x1", "token_idx")
    return box.select("doc_id", "token_idx", F.count("*").over(p).alias("line_count"), (F.row_number().over(w) - 1).cast("long").alias("line_order"), F.lag("token_idx").over(w).alias("prev_box"), F.round(F.col("x0") - F.lag("x1").over(w), 4).alias("prev_gap"), F.lead("token_idx").over(w).alias("next_box"), F.round(F.lead("x0").over(w) - F.col("x1"), 4).alias("next_gap"))


def nearest_run(box: DataFrame, run: DataFrame) -> DataFrame:
    """The run of the box's page that overlaps its height most, the one whose left edge is nearest first."""
    b = box.select("doc_id", "page_index", "token_idx", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "y1")])
    r = run.select("doc_id", "page_index", F.col("token_idx").alias("rt"), "x0", "y0", "y1")
    high = overlap("y0", "y1", "by0", "by1")
    j = bands.grid_join(b, r, ["doc_id", "page_index"], [bands.rows("by0", "by1", "y0", "y1")], high > 0)
    key = F.struct((-quantise(high)).alias("o"), quantise(F.abs(F.col("x0") - F.col("bx0"))).alias("d"), F.col("rt").alias("r"))
    return j.groupBy("doc_id", "token_idx").agg(F.min_by("rt", key).alias("rt"))


def nearest_left_span(box: DataFrame, run: DataFrame) -> DataFrame:
    b = box.select("doc_id", "line", "token_idx", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    j = b.join(run.select("doc_id", "line", F.col("token_idx").alias("rt"), "x0", "x1", "y0", "y1"), ["doc_id", "line"]).where("x1 <= bx0")
    key = F.struct(quantise(F.col("bx0") - F.col("x1")).alias("g"), (-quantise(overlap("by0", "by1", "y0", "y1"))).alias("v"), (-quantise((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("a"), "x0", "y0")
    return j.groupBy("doc_id", "token_idx").agg(F.min_by("rt", key).alias("rt"))


def grouped_span(spans: pd.DataFrame, gap: float = 6.0, ratio: float = 0.5) -> pd.DataFrame:
    """For applyInPandas: spans of one row and side by distance, chained while they are near to and level with what has grown."""
    n, x0, y0, x1, y1 = chained(sorted(zip(*(spans[c].tolist() for c in ("gap", "x0", "y0", "x1", "y1")))), gap, ratio)
    return pd.DataFrame({"doc_id": spans["doc_id"].iloc[:1].tolist(), "token_idx": spans["token_idx"].iloc[:1].tolist(), "n": [n], "x0": [x0], "y0": [y0], "x1": [x1], "y1": [y1]})


def chained(rows: list[tuple], gap: float = 6.0, ratio: float = 0.5) -> tuple:
    """n, x0, y0, x1, y1 of the chain that the first of (gap, x0, y0, x1, y1), sorted, begins."""
    (_, x0, y0, x1, y1), n = rows[0], 1
    for _, rx0, ry0, rx1, ry1 in rows[1:]:
        level = min(y1, ry1) - max(y0, ry0)
        if max(rx0 - x1, x0 - rx1) > gap or level < ratio * min(y1 - y0, ry1 - ry0):
            break
        x0, y0, x1, y1, n = min(x0, rx0), min(y0, ry0), max(x1, rx1), max(y1, ry1), n + 1
    return n, x0, y0, x1, y1


# The line bucket, the tolerance in height, the widest gap and the window at a box's edge, in points.
BUCKET_PT, LINE_PT, MAX_GAP_PT, EDGE_PT = 2.0, 8.0, 260.0, 24.0


def line_anchor(candidates: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The anchor that an overlay's prefix or suffix is drawn from: the farthest run near the box's edge on its line.

    candidates: keys, text, role (left, right or center), x0, y0, x1, y1 of a run, and bx0, bx1 and target_y of its box.
    """
    c = F.col
    middle = (c("y0") + c("y1")) / 2
    off = F.abs(middle - c("target_y"))
    level = (F.abs(F.round(middle / BUCKET_PT) - F.round(c("target_y") / BUCKET_PT)) <= 1) | (off <= LINE_PT)
    prefix = side == "prefix"
    gap = c("bx0") - c("x1") if prefix else c("x0") - c("bx1")
    reach = c("x0") <= c("bx1") + MAX_GAP_PT * 0.2 if prefix else c("x1") + MAX_GAP_PT * 0.2 >= c("bx0")
    d = candidates.where((F.trim("text") != "") & level & (c("role") != ("right" if prefix else "left")) & (gap <= F.least(F.lit(MAX_GAP_PT), F.lit(EDGE_PT))) & reach)
    order = F.struct((c("x0") if prefix else -c("x0")).alias("x"), off.alias("off"), "text")
    return d.groupBy(*keys).agg(F.min_by(F.struct("text", "x0", "x1"), order).alias("_a")).select(*keys, "_a.*")


def overlay_width(text: Column, size: Column, scale: Column, table: Column, first: Column) -> Column:
    """A text's width by a width table (units from a first code on); characters beyond it count nothing, and .6 of the size a character if none is in it."""
    units = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.when(F.ascii(x) >= first, F.get(table, F.ascii(x) - first)))
    known = F.filter(units, lambda x: x.isNotNull())
    width = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) * size / 1000)
    rest = F.greatest(F.abs(size), F.lit(1.0)) * 0.6 * F.greatest(F.char_length(text), F.lit(1))
    return F.when(width > 0, width).otherwise(rest) * F.greatest(scale / 100, F.lit(0.01))
