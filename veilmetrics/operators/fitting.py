"""The core ranking: all dictionary variants against all boxes, without their product.

A row's candidates are ordered by adjusted error (the error, and PENALTY_PT for a template that is not canonical), then by
letters, tokens and text; the first of each normalised text counts, and candidates that would run into a neighbouring box
do not. Only the best `top` are wanted, and three bounds make the work small without changing them:

- Variants of one width and one cost class stand in the same order in every row, so that a group (width, class) gives its
  best `top` normalised texts and no more. The groups are bounded by the widths that text on a page can have, however large
  the dictionary is, and are broadcast.
- A normalised text is in `spread` groups at most (its spellings differ in width); so the first top * spread candidates of a row hold `top`
  different texts, and groups that come after so many are never opened.
- The groups' texts are sorted by width, so that a row needs no more than that many on both sides of the width that it aims at. Tasks rank
  many rows at once by numpy; rows are shuffled once, to be dealt out, and candidates never. (`with_reach` bounds a row's reach by counts.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_up
from ..functions.widths import strict_units
from .measure import PENALTY_PT
from .measure import spread as rows_apart

TOP = 20
REACH_PT = (0.5, 3.5, 14.0, 56.0, 224.0, 16_384.0)  # the last is wider than any page
CELLS = [max(1, int(r * 25)) for r in REACH_PT[:-1]] + [1 << 40]  # units of a cell of widths, for each reach
KEYS = ["doc_id", "token_idx"]
MODES = ("two_sided", "left_only", "right_only")


def measured(variants: DataFrame, text: str = "text", template: str = "template") -> DataFrame:
    """text, template, canonical, norm, alpha, toks and units of the variants whose characters all have a width."""
    norm = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    d = variants.select(F.col(text).alias("text"), F.col(template).alias("template"), (F.col(template) == "canonical").alias("canonical"), norm.alias("norm"), strict_units(F.col(text)).alias("units"))
    d = d.withColumns({"alpha": F.length(F.regexp_replace("text", "[^A-Za-z]", "")), "toks": F.size(F.filter(F.split("norm", " "), lambda x: x != ""))})
    return d.where("units IS NOT NULL AND norm <> ''")


def width_groups(measured_: DataFrame, top: int = TOP) -> DataFrame:
    """units, canonical, n and ws, the best `top` variants of that width and class, one of each normalised text."""
    one = measured_.groupBy("units", "canonical", "norm").agg(F.min(F.struct(-F.col("alpha"), -F.col("toks"), "text", "template")).alias("v"))
    w = Window.partitionBy("units", "canonical").orderBy("v.col1", "v.col2", "norm", "v.text")
    best = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    item = F.struct(F.col("_n").alias("n"), F.col("v.text").alias("text"), F.col("v.template").alias("template"), "norm", F.col("v.col1").alias("less_alpha"), F.col("v.col2").alias("less_toks"))
    return best.groupBy("units", "canonical").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("ws"))


def _ranges(rows: DataFrame) -> DataFrame:
    """Adds _k (points a unit), _t (the width aimed at, in units) and _most (the widest that fits before the neighbours)."""
    scale = F.greatest(F.col("h_scale") / 100, F.lit(0.01)) if "h_scale" in rows.columns else F.lit(1.0)
    c = F.col
    right = c("mode") == "right_only"
    aim = F.when(c("mode") == "two_sided", c("right_edge") - c("left_edge")).when(c("mode") == "left_only", c("box_x1") - c("left_edge")).when(right, c("right_edge") - c("box_x0"))
    never = F.when(right, c("right_edge") - c("next_box_x0") > c("tolerance")).otherwise(c("prev_box_x1") - c("left_edge") > c("tolerance"))
    room = F.when(right, c("right_edge") + c("tolerance") - c("prev_box_x1")).otherwise(c("next_box_x0") + c("tolerance") - c("left_edge"))
    d = rows.withColumn("_k", c("font_size") / 1000 * scale)
    return d.withColumns({"_t": aim / c("_k"), "_most": F.when(F.coalesce(never, F.lit(False)), F.lit(-1.0)).otherwise(F.coalesce(room / c("_k"), F.lit(1e12)))})


def _cells(lo: Column, hi: Column, cell: int) -> Column:
    """Cells from lo to hi; none if hi is below lo or nothing fits."""
    a, b = F.floor(F.greatest(lo, F.lit(0.0)) / cell), F.floor(hi / cell)
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def with_reach(rows: DataFrame, groups: DataFrame, enough: int) -> DataFrame:
    """Adds `step`, the first reach within which whole cells hold `enough` candidates that fit.

    A row's cells are counted where the row is, if rows are dealt out by KEYS.
    """
    steps = range(len(REACH_PT) - 1)
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.floor(F.col("units") / CELLS[s]).alias("cell")) for s in steps]))
    counts = groups.select("canonical", "n", at.alias("_a")).groupBy("_a.step", "_a.cell").agg(F.sum(F.when(F.col("canonical"), F.col("n")).otherwise(0)).alias("plain"), F.sum(F.when(~F.col("canonical"), F.col("n")).otherwise(0)).alias("other"))
    # cells that lie wholly within the reach, less a unit for rounding, and before the neighbours
    near = lambda s: _cells(F.col("_t") - REACH_PT[s] / F.col("_k"), F.least(F.col("_t") + REACH_PT[s] / F.col("_k"), F.col("_most")), CELLS[s])
    tagged = lambda s: F.transform(near(s), lambda x: F.struct(F.lit(s).alias("step"), x.alias("cell")))
    inner = F.flatten(F.array(*map(tagged, steps)))
    held = [c for c in rows.columns if c not in KEYS]
    probe = rows.withColumn("_a", F.explode_outer(inner)).select(*rows.columns, "_a.*").join(F.broadcast(counts), ["step", "cell"], "left")
    size, reach = F.element_at(F.array(*map(F.lit, CELLS)), F.col("step") + 1), F.element_at(F.array(*map(F.lit, REACH_PT)), F.col("step") + 1)
    first, last = F.col("cell") * size, (F.col("cell") + 1) * size - 1

    def whole(penalty):
        b = (reach - penalty) / F.col("_k") - 1
        return (first >= F.col("_t") - b) & (last <= F.least(F.col("_t") + b, F.col("_most") - 1))

    n = F.when(whole(0.0), F.col("plain")).otherwise(0) + F.when(whole(PENALTY_PT), F.col("other")).otherwise(0)
    sums = probe.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in held], *[F.sum(F.when(F.col("step") == s, F.coalesce(n, F.lit(0)))).alias(f"_n{s}") for s in steps])
    step = F.coalesce(*[F.when(F.col(f"_n{s}") >= enough, F.lit(s)) for s in steps], F.lit(len(REACH_PT) - 1))
    return sums.select(*KEYS, *held, step.alias("step"))


class Items:
    """The groups' texts as flat arrays by class and width, small enough for each task, and what ranks them for many rows at once."""

    def __init__(self, groups: DataFrame):
        t = groups.select("units", "canonical", F.inline("ws")).toArrow()
        get = lambda c: t.column(c).to_pylist()
        key = list(zip(get("less_alpha"), get("less_toks"), get("norm"), get("text")))
        place = {k: i for i, k in enumerate(sorted(set(key)))}  # code points are in the order of their UTF-8
        order, units, canonical = np.array([place[k] for k in key], np.int64), np.array(get("units"), np.int64), np.array(get("canonical"), bool)
        at = np.lexsort((order, units, ~canonical))
        self.order, self.units, self.canonical, self.parted = order[at], units[at], canonical[at], int(canonical.sum())
        self.text, self.template, self.norm = (pa.array(get(c), pa.string()).take(pa.array(at)) for c in ("text", "template", "norm"))
        self.norm_id = self.norm.dictionary_encode().indices.to_numpy().astype(np.int64)
        self.spread = int(np.bincount(self.norm_id).max()) if len(at) else 1

    def rank(self, r: dict[str, np.ndarray], top: int) -> tuple[np.ndarray, ...]:
        """Of rows, nan for null: row, rank, item, error and adjusted error of the best `top` texts.

        A class's items on both sides of the width aimed at: `enough` of them, what a cut group may lack, and what may lie between
        the widest that fits and its rounding. All others have a higher adjusted error than `enough` that are among them.
        """
        enough = top * self.spread
        reach = np.arange(enough + 3 * top)
        found, allowed = [], []
        for a, z in ((0, self.parted), (self.parted, len(self.units))):
            own = self.units[a:z]
            end = np.searchsorted(own, r["_most"] + 1, "right")[:, None]
            mid = np.minimum(np.searchsorted(own, r["_t"])[:, None], end)
            k = np.concatenate([mid - 1 - reach, mid + reach], 1)
            allowed.append((k >= 0) & (k < end))
            found.append(np.clip(k + a, 0, len(self.units) - 1))
        k, ok = np.concatenate(found, 1), np.concatenate(allowed, 1)
        c = {name: v[:, None] for name, v in r.items()}
        width, right = self.units[k] * c["_k"], c["_mode"] == 3
        left, end = np.where(right, c["right_edge"] - width, c["left_edge"]), np.where(right, c["right_edge"], c["left_edge"] + width)
        error = np.abs(np.where(right, left - c["box_x0"], end - np.where(c["_mode"] == 1, c["right_edge"], c["box_x1"])))
        ok &= ~((c["prev_box_x1"] - left > c["tolerance"]) | (end - c["next_box_x0"] > c["tolerance"]))
        error = _round4(error, ok)
        adjusted = np.where(self.canonical[k], error, _round4(error + PENALTY_PT, ok))
        with np.errstate(invalid="ignore"):
            key = np.where(ok, np.rint(adjusted * 10_000).astype(np.int64) * (len(self.units) + 1) + self.order[k], np.iinfo(np.int64).max)
        best = np.argsort(key, 1, kind="stable")[:, :enough]
        k, ok, error, adjusted = (np.take_along_axis(v, best, 1) for v in (k, ok, error, adjusted))
        norm = np.where(ok, self.norm_id[k], -1)
        by_norm = np.argsort(norm, 1, kind="stable")
        of = np.take_along_axis(norm, by_norm, 1)
        fresh = np.ones(of.shape, bool)
        fresh[:, 1:] = of[:, 1:] != of[:, :-1]
        first = np.empty(of.shape, bool)
        np.put_along_axis(first, by_norm, fresh, 1)
        first &= ok
        rank = np.cumsum(first, 1)
        row, at = np.nonzero(first & (rank <= top))
        return row, rank[row, at], k[row, at], error[row, at], adjusted[row, at]


def _round4(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """To four places as Spark's round does it: what is close to a half by its decimal digits."""
    y = x * 10_000
    out = np.rint(y) / 10_000
    for at in zip(*np.nonzero(wanted & (np.abs(y - np.floor(y) - 0.5) < 1e-5))):
        out[at] = half_up(float(x[at]), 4)
    return out


NUMBERS = ["left_edge", "right_edge", "box_x0", "box_x1", "prev_box_x1", "next_box_x0", "tolerance", "_k", "_t", "_most"]
FOUND = "rank int, text string, template string, norm string, error_pt double, adjusted double"


def fitted(rows: DataFrame, variants: DataFrame, top: int = TOP, every: bool = False) -> DataFrame:
    """doc_id, token_idx, rank, text, template, norm, error_pt, adjusted and normalised of each resolved row's best `top` variants.

    rows: one for each (doc_id, token_idx), as measure.edges gives them, with a column tolerance (and h_scale, per cent, if
    it is not 100). variants: measured(). The result is that of the full product: ranked, duplicates by normalised text dropped.
    every: rows without a candidate stay, with nulls, and all have their mode and target_width.
    """
    groups = width_groups(variants, top)  # of bounded size
    items = rows.sparkSession.sparkContext.broadcast(Items(groups))
    d = _ranges(rows if every else rows.where("mode <> 'unresolved'")).withColumn("_mode", F.coalesce(F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")), F.lit(0)).cast("long"))
    own = ["mode", "target_width"] if every else []
    d = rows_apart(d.select(*[F.col(c).cast("long") for c in KEYS], "_mode", *[F.col(c).cast("double") for c in NUMBERS], *own), *KEYS)
    kind = "doc_id long, token_idx long, " + ("mode string, target_width double, " if every else "") + FOUND + ", tolerance double"

    def run(batches):
        it = items.value
        size = max(1, 400_000 // (4 * top * (it.spread + 3)))
        schema = None
        for big in batches:
            for at in range(0, big.num_rows, size):
                b = big.slice(at, size)
                n = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("_mode", *NUMBERS)}
                which = np.flatnonzero(n["_mode"] > 0) if len(it.units) else np.zeros(0, int)
                row, rank, k, error, adjusted = it.rank({c: v[which] for c, v in n.items()}, top) if len(which) else (np.zeros(0, int),) * 5
                row = which[row]
                none = np.setdiff1d(np.arange(b.num_rows), row) if every else np.zeros(0, int)
                of, item = pa.array(np.append(row, none)), pa.array(np.append(k, none), mask=np.append(k < 0, none >= 0))
                value = lambda v, none=none, row=row: pa.array(np.append(v, none), mask=np.append(row < 0, none >= 0))
                made = [b.column(c).take(of) for c in (*KEYS, *own)] + [value(rank).cast(pa.int32()), *(v.take(item) for v in (it.text, it.template, it.norm)), value(error.astype(float)), value(adjusted.astype(float)), b.column("tolerance").take(of)]
                schema = schema or pa.schema([(c.split()[0], v.type) for c, v in zip(kind.split(", "), made)])
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    ranked = d.mapInArrow(run, kind)
    return ranked.select(*KEYS, *own, *[c.split()[0] for c in FOUND.split(", ")], F.round(F.col("adjusted") / F.greatest("tolerance", F.lit(1.0)), 8).alias("normalised"))


def with_placeholders(boxes: DataFrame, rows: DataFrame | None, ranked: DataFrame) -> DataFrame:
    """Every box: its mode and target width (the box's own where it has no row, and 'unresolved'), with its candidates or one row of nulls.

    rows: None if each box has its own mode and target_width.
    """
    width = (F.col("x1") - F.col("x0")).alias("_w")
    d = boxes.select(*KEYS, width, "mode", "target_width") if rows is None else boxes.select(*KEYS, width).join(rows.select(*KEYS, "mode", "target_width"), KEYS, "left")
    d = d.join(ranked, KEYS, "left")
    return d.withColumns({"mode": F.coalesce("mode", F.lit("unresolved")), "target_width": F.round(F.coalesce("target_width", "_w"), 4)}).drop("_w")
