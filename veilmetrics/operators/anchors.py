"""From boxes and runs on real coordinates to one anchor decision a box, and the log of how it came about.

A box meets the runs of the lines that it overlaps or whose baseline it shares in one join; from then on its candidates are an array
of structs that is folded stage by stage: sides and relations, text rules, pairs, the nonlocal rule, the order of pairs, box
sanity, the one-sided fallback. Nothing is joined again, and rejected candidates stay in the arrays with their reason.
The arrays are bounded by the runs of a few lines. `diagnostics` turns them into events by a table of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import quantise
from .context import greedy_lines, ranked_lines

# Fixed values, in points: small overlap, baseline of the same line, flush punctuation, and the nonlocal rule's limits.
OVERLAP_PT, BASELINE_PT, FLUSH_PT = 3.0, 3.0, 0.25
NONLOCAL_DELTA_PT, NONLOCAL_RATIO, NONLOCAL_GAP_PT, NONLOCAL_DIFF_PT = 10.0, 0.15, 20.0, 10.0
SPACE_UNITS = 278.0
LINE_GAP_PT = 250.0
KEYS = ["doc_id", "page_index", "token_idx"]
RELATIONS = ["outside", "small_overlap", "deep_overlap", "opposite_side"]


def _relation(outside: Column, crosses: Column, inside: Column, depth: Column) -> Column:
    """0 outside, 1 small overlap, 2 deep overlap, 3 the other side."""
    return F.when(outside, 0).when(crosses, F.when(depth <= OVERLAP_PT, 1).otherwise(2)).when(inside, 2).otherwise(3)


def with_inner_edges(run: DataFrame) -> DataFrame:
    """Adds lead_pt, trail_pt (what blanks at a run's ends advance), inner_x0 and inner_x1."""
    text, pt = F.col("token"), lambda n: n * F.lit(SPACE_UNITS) * F.col("font_size") / F.lit(1000.0)
    lead, trail = F.length(text) - F.length(F.ltrim(text)), F.length(text) - F.length(F.rtrim(text))
    d = run.withColumns({"lead_pt": pt(lead), "trail_pt": F.when(F.trim(text) == "", F.lit(0.0)).otherwise(pt(trail))})
    return d.withColumns({"inner_x0": F.col("x0") + F.col("lead_pt"), "inner_x1": F.col("x1") - F.col("trail_pt")})


def _candidate(c, bx0: Column, bx1: Column) -> Column:
    """A run's relation to both edges of a box. c: the run's and its line's columns by name."""
    left_depth, right_depth = F.greatest(c("inner_x1") - bx0, F.lit(0.0)), F.greatest(bx1 - c("inner_x0"), F.lit(0.0))
    left = _relation(c("inner_x1") <= bx0, c("inner_x0") < bx0, c("inner_x0") < bx1, left_depth)
    right = _relation(c("inner_x0") >= bx1, c("inner_x1") > bx1, c("inner_x1") > bx0, right_depth)
    side = lambda rel, gap, depth: F.struct(rel.alias("relation"), gap.alias("gap"), depth.alias("depth"))
    own = [c(k).alias(k) for k in ("line_rank", "rt", "text", "inner_x0", "inner_x1", "lead_pt", "trail_pt", "w", "over", "base")]
    return F.struct(*own, side(left, F.abs(c("inner_x1") - bx0), left_depth).alias("left"), side(right, F.abs(c("inner_x0") - bx1), right_depth).alias("right"))


def candidate_pool(box: DataFrame, run: DataFrame) -> DataFrame:
    """KEYS, bx0, bx1 and `pool` of every box: its lines' runs with their relation to both of its edges; empty without a line.

    box: KEYS, x0, y0, x1, y1. run: doc_id, page_index, token_idx, token, font_size, x0, y0, x1, y1.
    """
    lines = ranked_lines(box, run).select(*KEYS, "bucket", (F.col("rank") - 1).alias("line_rank"), (F.col("ov") > 0).alias("over"), (F.col("delta") <= BASELINE_PT).alias("base"))
    r = with_inner_edges(greedy_lines(run)).select("doc_id", "page_index", "bucket", F.col("token_idx").alias("rt"), F.col("token").alias("text"), "inner_x0", "inner_x1", "lead_pt", "trail_pt", F.abs(F.col("x1") - F.col("x0")).alias("w"))
    j = lines.join(box.select(*KEYS, F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), KEYS).join(r, ["doc_id", "page_index", "bucket"])
    one = _candidate(F.col, F.col("bx0"), F.col("bx1"))
    pool = j.groupBy(*KEYS).agg(F.collect_list(one).alias("pool"), F.max("line_rank").alias("_lines"))
    d = box.select(*KEYS, F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1")).join(pool, KEYS, "left")
    kind = pool.schema["pool"].dataType
    return d.withColumns({"pool": F.coalesce("pool", F.array().cast(kind)), "n_lines": F.coalesce(F.col("_lines") + 1, F.lit(0))}).drop("_lines")


def page_lines(runs: str) -> tuple[dict[str, Column], ...]:
    """Columns to add one after another, until `lines` has the greedy lines of an array of runs: bucket, ly0, ly1 and runs by (y1, x0)."""
    key = lambda r: F.struct(r["y1"].alias("y1"), r["x0"].alias("x0"), r["token_idx"].alias("rt"), r["token"].alias("text"), r["font_size"].alias("font_size"), r["y0"].alias("y0"), r["x1"].alias("x1"))
    at = lambda i: F.get("_sorted", i)
    joins = lambda i: F.coalesce((F.abs(at(i)["y1"] - at(i - 1)["y1"]) <= BASELINE_PT) & (at(i)["x0"] - at(i - 1)["x1"] <= LINE_GAP_PT), F.lit(False))
    index = F.when(F.size("_sorted") > 0, F.sequence(F.lit(0), F.size("_sorted") - 1)).otherwise(F.array().cast("array<int>"))
    ends = lambda rs, f, k: f(F.transform(rs, lambda r: r[k]))

    def line(s, k):
        rs = F.slice("_sorted", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - s)
        return F.struct(k.alias("bucket"), ends(rs, F.array_min, "y0").alias("ly0"), ends(rs, F.array_max, "y1").alias("ly1"), F.transform(rs, _inner).alias("runs"))

    return {"_sorted": F.array_sort(F.transform(runs, key))}, {"_starts": F.filter(index, lambda i: ~joins(i))}, {"lines": F.transform("_starts", line)}


def _inner(r: Column) -> Column:
    """A run with its inner edges, as with_inner_edges has them."""
    text, pt = r["text"], lambda n: n * F.lit(SPACE_UNITS) * r["font_size"] / F.lit(1000.0)
    lead = pt(F.length(text) - F.length(F.ltrim(text)))
    trail = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(pt(F.length(text) - F.length(F.rtrim(text))))
    return F.struct(r["rt"].alias("rt"), text.alias("text"), (r["x0"] + lead).alias("inner_x0"), (r["x1"] - trail).alias("inner_x1"), lead.alias("lead_pt"), trail.alias("trail_pt"), F.abs(r["x1"] - r["x0"]).alias("w"))


def page_pool(pages: DataFrame) -> DataFrame:
    """What candidate_pool gives, from pages whose boxes and runs are arrays in one row: nothing is joined or shuffled.

    pages: doc_id, page_index, boxes (token_idx, x0, y0, x1, y1) and runs (token_idx, token, font_size, x0, y0, x1, y1). For pages
    of bounded size; candidate_pool takes tables, and a page of any size.
    """
    d = pages
    for step in page_lines("runs"):
        d = d.withColumns(step)
    # outer, and the filter on its result: see the README
    d = d.select("doc_id", "page_index", "lines", F.explode_outer("boxes").alias("b")).where("b is not null")
    c = F.col
    ov, delta = lambda l: F.greatest(F.lit(0.0), F.least(c("b.y1"), l["ly1"]) - F.greatest(c("b.y0"), l["ly0"])), lambda l: F.abs(l["ly1"] - c("b.y1"))
    near = F.filter("lines", lambda l: (F.least(c("b.y1"), l["ly1"]) - F.greatest(c("b.y0"), l["ly0"]) > 0) | (delta(l) <= BASELINE_PT))
    ranked = F.array_sort(F.transform(near, lambda l: F.struct((-quantise(ov(l))).alias("ov_q"), quantise(delta(l)).alias("delta_q"), l["bucket"].alias("bucket"), (ov(l) > 0).alias("over"), (delta(l) <= BASELINE_PT).alias("base"), l["runs"].alias("runs"))))
    d = d.select(*KEYS[:2], "b.token_idx", c("b.x0").alias("bx0"), c("b.x1").alias("bx1"), c("b.y0").alias("by0"), c("b.y1").alias("by1"), ranked.alias("_near"))
    of_line = lambda l, k: {"line_rank": k, "over": l["over"], "base": l["base"]}
    met = lambda l, k: F.transform(l["runs"], lambda r: _candidate(lambda name: of_line(l, k).get(name, r[name]), c("bx0"), c("bx1")))
    return d.withColumns({"pool": F.flatten(F.transform("_near", met)), "n_lines": F.size("_near")}).drop("_near")


def _ranked_side(side: str) -> Column:
    """Candidates of a side in order of line, relation, gap, depth and width, with blank and impossible ones left out."""
    s = lambda x, k: x[side][k]
    allowed = F.filter("pool", lambda x: (F.trim(x["text"]) != "") & (s(x, "relation") < 2))
    key = lambda x: F.struct(x["line_rank"].alias("line_rank"), s(x, "relation").alias("relation"), quantise(s(x, "gap")).alias("gap_q"), quantise(s(x, "depth")).alias("depth_q"), quantise(x["w"]).alias("w_q"), x["rt"].alias("rt"),
        x["text"].alias("text"), s(x, "gap").alias("gap"), x["inner_x0"].alias("inner_x0"), x["inner_x1"].alias("inner_x1"), x["lead_pt"].alias("lead_pt"), x["trail_pt"].alias("trail_pt"), x["over"].alias("over"), x["base"].alias("base"))
    return F.array_sort(F.transform(allowed, key))


def _judged(name: str) -> Column:
    """The ranked candidates with `status`: ok, punctuation (flush with the edge and nearest of its line) or non_alnum."""
    first = lambda x, i: (i == 0) | (F.get(name, i - 1)["line_rank"] != x["line_rank"])
    flush = lambda x, i: F.rlike(F.trim(x["text"]), F.lit(r"^[!-/:-@\[-`{-~]+$")) & first(x, i) & (x["relation"] == 0) & (x["gap"] <= FLUSH_PT)
    status = lambda x, i: F.when(F.rlike(x["text"], F.lit(r"[\p{L}\p{N}]")), "ok").when(flush(x, i), "punctuation").otherwise("non_alnum")
    return F.transform(name, lambda x, i: x.withField("status", status(x, i)))


def _pair(l: Column, r: Column) -> Column:
    low, high = l["inner_x1"] + F.greatest(l["trail_pt"], F.lit(0.0)), r["inner_x0"] - F.greatest(r["lead_pt"], F.lit(0.0))
    width = F.when(high > low, high - low)
    box, most = F.abs(F.col("bx1") - F.col("bx0")), F.greatest(l["gap"], r["gap"])
    wide = (width > box) & (width - box >= F.greatest(F.lit(NONLOCAL_DELTA_PT), box * NONLOCAL_RATIO))
    nonlocal_ = l["over"] & ~l["base"] & F.coalesce(wide, F.lit(False)) & ((most > NONLOCAL_GAP_PT) | (F.abs(l["gap"] - r["gap"]) > NONLOCAL_DIFF_PT))
    return F.struct(l["line_rank"].alias("line_rank"), quantise(l["gap"] + r["gap"]).alias("gap_sum"), quantise(most).alias("gap_max"), l["gap_q"].alias("left_gap"), r["gap_q"].alias("right_gap"), l["rt"].alias("left_rt"), r["rt"].alias("right_rt"),
        width.alias("width"), F.abs(width - box).alias("delta"), F.when(nonlocal_, "nonlocal").otherwise("valid").alias("status"), low.alias("low"), high.alias("high"))


def resolve(pool: DataFrame) -> DataFrame:
    """The pool with `lefts`, `rights` (candidates by rank, with status), `pairs` (in order, with status), `initial`, `chosen`, mode, reason, left_rt, right_rt, seed, left_edge, right_edge and target_width.

    A pair's status is selected, replaced (first in order, but box sanity chose another), valid or nonlocal.
    """
    d = pool.withColumns({"lefts": _ranked_side("left"), "rights": _ranked_side("right")})
    d = d.withColumns({"lefts": _judged("lefts"), "rights": _judged("rights")})
    good = lambda c: F.filter(c, lambda x: x["status"] != "non_alnum")
    d = d.withColumns({"_l": good("lefts"), "_r": good("rights")})
    d = d.withColumn("_pairs", F.array_sort(F.flatten(F.transform("_l", lambda l: F.transform(F.filter("_r", lambda r: r["line_rank"] == l["line_rank"]), lambda r: _pair(l, r))))))
    d = d.withColumn("_valid", F.filter("_pairs", lambda p: p["status"] == "valid")).withColumn("initial", F.get("_valid", F.lit(0)))
    box = F.abs(F.col("bx1") - F.col("bx0"))
    better = F.transform(F.filter("_valid", lambda p: p["delta"] < F.col("initial.delta")), lambda p: F.struct(quantise(p["delta"]).alias("d"), p["line_rank"].alias("line_rank"), p["left_rt"].alias("left_rt"), p["right_rt"].alias("right_rt"), p.alias("p")))
    d = d.withColumn("suspect", F.coalesce(F.col("initial.width") > box, F.lit(False)))
    d = d.withColumn("_better", F.when(F.col("suspect"), F.get(F.array_sort(better), F.lit(0))["p"]))
    d = d.withColumns({"chosen": F.coalesce("_better", "initial"), "overridden": F.col("_better").isNotNull()})
    same = lambda p, c: (p["left_rt"] == F.col(f"{c}.left_rt")) & (p["right_rt"] == F.col(f"{c}.right_rt"))
    status = lambda p: F.when(p["status"] == "nonlocal", "nonlocal").when(same(p, "chosen"), "selected").when(same(p, "initial"), "replaced").otherwise("valid")
    d = d.withColumn("pairs", F.transform("_pairs", lambda p: p.withField("status", status(p))))
    # the fallback: the best of each side, by line first; of two, the one with the smaller gap
    d = d.withColumns({"_bl": F.get("_l", F.lit(0)), "_br": F.get("_r", F.lit(0))})
    own = lambda c: F.struct(F.col(f"{c}.gap_q"), F.col(f"{c}.line_rank"), F.col(f"{c}.rt"))
    has_l, has_r, pair = F.col("_bl").isNotNull(), F.col("_br").isNotNull(), F.col("chosen").isNotNull()
    nearer = own("_bl") <= own("_br")
    mode = F.when(pair, "two_sided").when(has_l & has_r, F.when(nearer, "left_only").otherwise("right_only")).when(has_l, "left_only").when(has_r, "right_only").otherwise("unresolved")
    reason = (F.when(F.col("overridden"), "pair_candidate_selected_box_sanity_override").when(pair, "pair_candidate_selected")
        .when(has_l & has_r, F.when(nearer, "one_sided_no_valid_pair_left_gap_selected").otherwise("one_sided_no_valid_pair_right_gap_selected"))
        .when(has_l, "one_sided_only_left_candidate_available").when(has_r, "one_sided_only_right_candidate_available")
        .when(F.col("n_lines") == 0, "unresolved_no_eligible_line_bucket").otherwise("unresolved_no_valid_anchor_spans"))
    d = d.withColumns({"mode": mode, "reason": reason})
    left, right = F.col("mode") == "left_only", F.col("mode") == "right_only"
    edge_l = F.when(pair, F.col("chosen.low")).when(left, F.col("_bl.inner_x1") + F.col("_bl.trail_pt"))
    edge_r = F.when(pair, F.col("chosen.high")).when(right, F.col("_br.inner_x0") - F.col("_br.lead_pt"))
    d = d.withColumns({
        "left_rt": F.when(pair, F.col("chosen.left_rt")).when(left, F.col("_bl.rt")), "right_rt": F.when(pair, F.col("chosen.right_rt")).when(right, F.col("_br.rt")), "left_edge": edge_l, "right_edge": edge_r,
        "seed": F.when(pair, F.when(F.col("chosen.left_gap") <= F.col("chosen.right_gap"), "left").otherwise("right")).when(left, "left").when(right, "right")})
    d = d.withColumn("target_width", F.when(F.col("right_edge") > F.col("left_edge"), F.col("right_edge") - F.col("left_edge")).otherwise(box))
    return d.drop("_l", "_r", "_pairs", "_valid", "_better", "_bl", "_br")


# the log


def _event(stage: str, code: str, level: str, item: Column | None, **metrics: Column) -> Column:
    """struct(stage, code, level, item, metrics); item: which run or pair, null for the box itself."""
    entries = [x for k, v in metrics.items() for x in (F.lit(k), F.round(v.cast("double"), 4))]
    made = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(level).alias("level"), (F.lit(None) if item is None else item).cast("string").alias("item"), F.map_filter(made, lambda _, v: v.isNotNull()).alias("metrics"))


def _each(array: str, when, event) -> Column:
    return F.transform(F.filter(array, when), event)


def _once(when: Column, event: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(event)).otherwise(F.array().cast("array<struct<stage:string,code:string,level:string,item:string,metrics:map<string,double>>>"))


def event_rules(page_w: float = 612.0, page_h: float = 792.0) -> list[Column]:
    """The rule table over the columns of `resolve`: each an array of events. Codes are fixed values."""
    c, n = F.col, lambda a, when: F.size(F.filter(a, when))
    width, height = c("bx1") - c("bx0"), c("by1") - c("by0")
    box = F.abs(width)
    pair_id = lambda p: F.concat_ws("|", p["left_rt"].cast("string"), p["right_rt"].cast("string"))
    pair_metrics = lambda p: {"gap_sum": p["gap_sum"] / 10_000, "gap_max": p["gap_max"] / 10_000, "pair_target_width_pt": p["width"], "pair_box_delta_pt": p["delta"], "line_rank": p["line_rank"]}
    chosen = {k: c(f"chosen.{v}") for k, v in (("pair_target_width_pt", "width"), ("pair_box_delta_pt", "delta"), ("line_rank", "line_rank"))}
    pool_counts = {"line_buckets": c("n_lines"), "pairs": F.size("pairs"), "valid_pairs": n("pairs", lambda p: p["status"] != "nonlocal")}
    has_pair, one = c("initial").isNotNull(), c("mode").isin("left_only", "right_only")
    rules = [
        _once(F.lit(True), _event("box", "redaction_considered", "info", None, width=width, height=height)),
        _once((box < 1) | (F.abs(height) < 1), _event("box", "redaction_edge_too_short", "warn", None, width=width, height=height)),
        _once(box * F.abs(height) < 4, _event("box", "redaction_area_too_small", "warn", None, area=box * F.abs(height))),
        _once((c("bx0") < 0) | (c("bx1") > page_w) | (c("by0") < 0) | (c("by1") > page_h), _event("box", "redaction_out_of_page_bounds", "warn", None, x0=c("bx0"), x1=c("bx1"))),
        _once(box * F.abs(height) >= 0.9 * page_w * page_h, _event("box", "redaction_covers_page", "warn", None, area=box * F.abs(height))),
        _once(c("n_lines") == 0, _event("line", "line_bucket_pool_no_eligible_candidates", "warn", None)),
        _once(c("n_lines") > 0, _event("line", "line_bucket_candidate_summary", "info", None, line_buckets=c("n_lines"), runs=F.size("pool"))),
        _once(F.coalesce(c("chosen.line_rank"), F.lit(-1)) >= 0, _event("line", "line_bucket_selected", "info", None, line_rank=c("chosen.line_rank"))),
        _once(c("chosen.line_rank") > 0, _event("line", "line_bucket_selected_not_first", "info", None, line_rank=c("chosen.line_rank"))),
        _once(F.exists("pool", lambda x: x["over"] & ~x["base"]), _event("line", "line_bucket_overlap_only", "info", None, runs=n("pool", lambda x: x["over"] & ~x["base"]))),
        _once(F.exists("pool", lambda x: x["base"]), _event("line", "line_bucket_same_baseline", "info", None, runs=n("pool", lambda x: x["base"]))),
        _each("pool", lambda x: F.trim(x["text"]) == "", lambda x: _event("run", "anchor_run_rejected_empty_text", "info", x["rt"])),
    ]
    for side, edge in (("left", "inner_x1"), ("right", "inner_x0")):
        plural, shown = f"{side}s", lambda x: F.trim(x["text"]) != ""
        counts = {"candidates": F.size(plural), "usable": n(plural, lambda x: x["status"] != "non_alnum")}
        rules += [
            _each("pool", shown, _run_event(side, f"anchor_{side}_run_candidate_considered", edge)),
            _each("pool", _run_has(side, 2), _run_event(side, f"anchor_{side}_run_rejected_deep_overlap", edge)),
            _each("pool", _run_has(side, 3), _run_event(side, f"anchor_{side}_run_rejected_opposite_side", edge)),
            _each("pool", _run_has(side, 1), _run_event(side, f"anchor_{side}_run_selected_small_overlap", edge)),
            F.transform(plural, lambda x: _event("span", _CODE["considered"], "info", x["rt"], gap=x["gap"], relation=x["relation"], line_rank=x["line_rank"])),
            _each(plural, lambda x: x["status"] == "non_alnum", lambda x: _event("span", _CODE["non_alnum"], "info", x["rt"], gap=x["gap"])),
            _each(plural, lambda x: x["status"] == "punctuation", lambda x: _event("span", _CODE["punctuation"], "info", x["rt"], gap=x["gap"])),
            _each(plural, lambda x: x["trail_pt"] + x["lead_pt"] > 0, lambda x: _event("span", "anchor_inner_edges_selected", "info", x["rt"], lead=x["lead_pt"], trail=x["trail_pt"])),
            _once(F.lit(True), _event("side", f"anchor_{side}_candidate_summary", "info", None, **counts)),
            _once(counts["usable"] == 0, _event("side", f"anchor_bucket_missing_{side}_candidates", "warn", None, **counts)),
        ]
    rules += [
        F.transform("pairs", lambda p: _event("pair", "anchor_pair_candidate_considered", "info", pair_id(p), **pair_metrics(p))),
        _each("pairs", lambda p: p["status"] != "nonlocal", lambda p: _event("pair", "anchor_pair_candidate_valid", "info", pair_id(p), **pair_metrics(p))),
        _each("pairs", lambda p: p["status"] == "nonlocal", lambda p: _event("pair", "anchor_pair_rejected_overlap_only_nonlocal_bucket", "info", pair_id(p), **pair_metrics(p))),
        _each("pairs", lambda p: p["status"] == "replaced", lambda p: _event("pair", "anchor_pair_replaced_by_box_sanity", "info", pair_id(p), **pair_metrics(p))),
        _each("pairs", lambda p: p["width"].isNull(), lambda p: _event("pair", "anchor_pair_width_unavailable", "info", pair_id(p))),
        _once(F.exists("pairs", lambda p: p["status"] == "nonlocal"), _event("pair", "anchor_pair_pool_post_nonlocal_filter_summary", "info", None, **pool_counts)),
        _once(F.lit(True), _event("pair", "anchor_pair_pool_summary", "info", None, **pool_counts)),
        _once(~has_pair, _event("pair", "anchor_pair_pool_empty", "warn", None, **pool_counts)),
        _once(has_pair & c("initial.width").isNotNull(), _event("pair", "anchor_pair_span_box_delta_computed", "info", None, delta=c("initial.delta"))),
        _once(c("suspect"), _event("pair", "anchor_pair_span_box_delta_suspect", "warn", None, delta=c("initial.delta"), width=c("initial.width"))),
        _once(c("overridden"), _event("pair", "anchor_pair_selected_box_sanity_override", "warn", None, improvement=c("initial.delta") - c("chosen.delta"), **chosen)),
        _once(has_pair & ~c("overridden"), _event("pair", "anchor_pair_selected_without_box_override", "info", None, **chosen)),
        _once(has_pair, _event("pair", "anchor_pair_selected", "info", None, **chosen)),
        _once(one, _event("final", "anchor_one_sided_selected", "info", None, line_buckets=c("n_lines"))),
        _once(c("mode") == "unresolved", _event("final", "anchor_unresolved", "warn", None, line_buckets=c("n_lines"))),
        _once(F.lit(True), _event("final", "anchor_resolution_final", "info", None, target_width=c("target_width"))),
        *[_once(c("reason") == r, _event("final", r, "info", None)) for r in REASONS],
        _once(c("seed") == "left", _event("final", "measurement_seed_left", "info", None)),
        _once(c("seed") == "right", _event("final", "measurement_seed_right", "info", None)),
        _once(c("right_edge") > c("left_edge"), _event("geometry", "anchor_target_width_computed", "info", None, width=c("target_width"))),
        _once(c("right_edge") <= c("left_edge"), _event("geometry", "anchor_target_width_invalid", "warn", None, left=c("left_edge"), right=c("right_edge"))),
        _once(c("left_edge").isNull() | c("right_edge").isNull(), _event("geometry", "anchor_target_width_from_box", "info", None, width=c("target_width"))),
        _once(c("target_width") > box + 1, _event("geometry", "target_width_above_box", "info", None, delta=c("target_width") - box)),
        _once(c("target_width") < box - 1, _event("geometry", "target_width_below_box", "info", None, delta=c("target_width") - box)),
    ]
    return rules


_CODE = {"considered": "anchor_span_candidate_considered", "non_alnum": "anchor_span_rejected_non_alnum", "punctuation": "anchor_span_allowed_boundary_punctuation"}
REASONS = ["pair_candidate_selected", "pair_candidate_selected_box_sanity_override", "one_sided_no_valid_pair_left_gap_selected", "one_sided_no_valid_pair_right_gap_selected", "one_sided_only_left_candidate_available",
    "one_sided_only_right_candidate_available", "unresolved_no_eligible_line_bucket", "unresolved_no_valid_anchor_spans"]


def _run_has(side: str, relation: int):
    return lambda x: (F.trim(x["text"]) != "") & (x[side]["relation"] == relation)


def _run_event(side: str, code: str, edge: str):
    return lambda x: _event("run", code, "info", x["rt"], gap=x[side]["gap"], depth=x[side]["depth"], edge=x[edge])


def diagnostics(resolved: DataFrame) -> DataFrame:
    """KEYS, stage, code, level, item, metrics and `place`, which orders the events of a box as they came about.

    (doc_id, page_index, token_idx, place) is a total order that needs no sort of all events: place is the position in the
    box's own array, by rule and then by rank.
    """
    d = resolved.select(*KEYS, F.flatten(F.array(*event_rules())).alias("_events"))
    # outer, though no box is without events: the filter that Spark infers for the other kind would work all rules out again
    return d.select(*KEYS, F.posexplode_outer("_events").alias("place", "e")).select(*KEYS, "place", "e.*")


def box_histograms(resolved: DataFrame, per: list[str]) -> DataFrame:
    """`histograms` of the boxes' own arrays: a code is counted within its box, and what is shuffled is one row a file and code, summed in the tasks."""
    d = resolved.select(*per, F.flatten(F.array(*event_rules())).alias("_events")).select(*per, F.transform("_events", lambda e: e["code"]).alias("_codes"))
    each = F.transform(F.array_distinct("_codes"), lambda k: F.struct(k.alias("code"), F.size(F.filter("_codes", lambda x: x == k)).alias("n")))
    one = d.select(*per, F.explode_outer(each).alias("e")).groupBy(*per, "e.code").agg(F.sum("e.n").alias("n"), F.count("*").alias("boxes"))
    return one.groupingSets([[*map(F.col, per), F.col("code")], [F.col("code")]], *map(F.col, per), F.col("code")).agg(F.sum("n").alias("n"), F.sum("boxes").alias("boxes"))


def facts(events: DataFrame, code: str, metrics: list[str]) -> DataFrame:
    """E60: the metrics of one code's events, back in columns."""
    return events.where(F.col("code") == code).select(*KEYS, "item", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])


def histograms(events: DataFrame, per: list[str]) -> DataFrame:
    """P17: how often each code occurs, for each file and for the corpus (null keys)."""
    return events.groupingSets([[*map(F.col, per), F.col("code")], [F.col("code")]], *map(F.col, per), F.col("code")).agg(F.count("*").alias("n"), F.countDistinct(*KEYS).alias("boxes"))
