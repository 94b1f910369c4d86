"""Further signals: boundaries and sanity of anchors, overlays, dark-run profiles, provenance, rescoring, dossier rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.widths import HELVETICA
from ..operators import analysis as an
from ..operators import context, detection, measure
from ..operators import typography as ty
from ..sources import layout, lines
from .evaluation import RANKS, ranks
from .flagship import EDGES_SQL
from .spatial import J18

L = layout.SQL
QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("j15_boundary_geometry", "select conv_id, turn, length(text) - length(ltrim(text)) as leading, length(text) - length(rtrim(text)) as trailing, round((length(text) - length(ltrim(text))) * 278 * 10 / 1000.0::double, 4) as inner_left from (select conv_id, turn, repeat(' ', turn::int % 3) || text || repeat(' ', conv_id::int % 2) as text from conversations)")
def j15(spark, d):
    text = F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), "text", F.repeat(F.lit(" "), (F.col("conv_id") % 2).cast("int")))
    c = t(spark, d, "conversations").select("conv_id", "turn", ty.boundary(text, F.lit(10)).alias("b"))
    return c.select("conv_id", "turn", "b.leading", "b.trailing", F.col("b.lead_pt").alias("inner_left"))


@query("j19_nonlocal_pairs", L + J18 + "select doc_id, token_idx, left_rt, right_rt from pr where gap_max <= 180000 and gap_sum <= 240000")
def j19(spark, d):
    tok = layout.load(spark, d)
    return context.anchor_pairs(layout.detected(layout.boxes(tok)), layout.runs(tok)).where("gap_max <= 180000 and gap_sum <= 240000").select("doc_id", "token_idx", "left_rt", "right_rt")


@query("j21_box_sanity", L + J18 + """, sp as (select pr.*, abs(gap_sum) as off, row_number() over (partition by doc_id, token_idx order by gap_sum, gap_max, left_rt desc, right_rt) as k1, row_number() over (partition by doc_id, token_idx order by abs(gap_sum - 50000), left_rt desc, right_rt) as k2 from pr)
select doc_id, token_idx, case when max(gap_sum) filter (where k1 = 1) > 100000 then max(left_rt) filter (where k2 = 1) else max(left_rt) filter (where k1 = 1) end as left_rt from sp group by 1, 2""")
def j21(spark, d):
    tok = layout.load(spark, d)
    p = context.anchor_pairs(layout.detected(layout.boxes(tok)), layout.runs(tok))
    first = F.min_by(F.struct("left_rt", "gap_sum"), F.struct("gap_sum", "gap_max", -F.col("left_rt"), "right_rt"))
    sane = F.min_by("left_rt", F.struct(F.abs(F.col("gap_sum") - 50000), -F.col("left_rt"), "right_rt"))
    a = p.groupBy("doc_id", "token_idx").agg(first.alias("f"), sane.alias("s"))
    return a.select("doc_id", "token_idx", F.when(F.col("f.gap_sum") > 100000, F.col("s")).otherwise(F.col("f.left_rt")).alias("left_rt"))


PROFILE = """, c as (select doc_id, line, token_idx, units >= 1200 as dark from tok), f as (select *, dark or (coalesce(lag(dark) over w, false) and coalesce(lead(dark) over w, false)) as filled from c window w as (partition by doc_id, line order by token_idx)),
 r as (select *, row_number() over (partition by doc_id, line order by token_idx) - row_number() over (partition by doc_id, line, filled order by token_idx) as isl from f), runs_ as (select doc_id, line, isl, min(token_idx) as a, max(token_idx) + 1 as z from r where filled group by 1, 2, 3)
"""


def dark_runs(spark, d):
    c = layout.load(spark, d).select("doc_id", "line", "token_idx", (F.col("units") >= 1200).alias("dark"))
    f = detection.fill_bright_gaps(c, ["doc_id", "line"], "token_idx", "dark")
    return f, detection.dark_runs(f, ["doc_id", "line"], "token_idx", "filled")


@query("d10_dark_run_profile", L + PROFILE + "select doc_id, line, count(*) as n_runs, max(z - a) as longest, round(sum(z - a) / 12.0::double, 6) as coverage from runs_ group by 1, 2")
def d10(spark, d):
    return detection.run_profile(dark_runs(spark, d)[1], ["doc_id", "line"], 12)


@query("d11_gap_fill", L + PROFILE + "select doc_id, count(*) filter (where filled and not dark) as bridged, count(*) filter (where dark) as dark_ from f group by 1")
def d11(spark, d):
    return dark_runs(spark, d)[0].groupBy("doc_id").agg(F.count_if(F.col("filled") & ~F.col("dark")).alias("bridged"), F.count_if("dark").alias("dark_"))


@query("d12_region_split", L + PROFILE + ", n as (select *, count(*) over (partition by doc_id, line) as k from runs_) select doc_id, line, a, z, round(case when k > 1 then 0.85::double + 0.15 / k else 1 end, 6) as factor from n")
def d12(spark, d):
    return detection.split_factor(dark_runs(spark, d)[1], ["doc_id", "line"]).select("doc_id", "line", "a", "z", "factor")


@query("o05_joinable_context", L + "select doc_id, line, token_idx from tok where lower(token) in ('and', 'et', 'und', 'y') and token_idx % 12 between 1 and 10")
def o05(spark, d):
    return layout.load(spark, d).where(F.lower("token").isin("and", "et", "und", "y") & (F.col("token_idx") % 12).between(1, 10)).select("doc_id", "line", "token_idx")


@query("o08_overlay_assembly", L + EDGES_SQL + """, f as (select *, case mode when 'two_sided' then 'anchored_pair' when 'unresolved' then 'plain' else 'selected_only' end as style, max(box_x1) over (partition by doc_id, line order by token_idx rows between unbounded preceding and 1 preceding) as floor_ from edge)
select doc_id, token_idx, style, round(greatest(coalesce(left_edge, box_x0), coalesce(floor_, 0)), 4) as text_x from f""")
def o08(spark, d):
    e = lines.load_edges(spark, d)
    w = Window.partitionBy("doc_id", "line").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, -1)
    style = F.when(F.col("mode") == "two_sided", "anchored_pair").when(F.col("mode") == "unresolved", "plain").otherwise("selected_only")
    return e.select("doc_id", "token_idx", style.alias("style"), F.round(F.greatest(F.coalesce("left_edge", "box_x0"), F.coalesce(F.max("box_x1").over(w), F.lit(0.0))), 4).alias("text_x"))


@query("e37_source_provenance", f"with {RANKS}, b as (select label, arg_min(cand, (err, cand)) as top from rk group by 1) select rk.label, count(distinct fam) as families, count(*) filter (where cand = top) as same_source from rk join b using (label) group by 1")
def e37(spark, d):
    return an.source_provenance(ranks(spark, d), ["label"], "cand", "fam", "err", ["cand"])


@query("e44_overlap_without_scale", L + EDGES_SQL + "select doc_id, token_idx, round(left_edge + units * font_size / 1000::double - next_box_x0, 4) as overlap_pt, left_edge + units * font_size / 1000::double - next_box_x0 > 1 as still_rejected from edge where next_box_x0 is not null and left_edge is not null")
def e44(spark, d):
    j = lines.load_edges(spark, d).where("next_box_x0 is not null and left_edge is not null")
    over = F.col("left_edge") + F.col("units") * F.col("font_size") / F.lit(1000.0) - F.col("next_box_x0")
    return j.select("doc_id", "token_idx", F.round(over, 4).alias("overlap_pt"), (over > 1).alias("still_rejected"))


@query("e58_rescore", f"with {RANKS} select label, arg_min(cand, (abs(err - 30000), cand)) as top, row_number() over (order by label) > 0 as kept from rk group by 1")
def e58(spark, d):
    return an.rescored_top(ranks(spark, d), ["label"], "err", F.lit(30000), "cand", ["cand"]).withColumn("kept", F.lit(True))


@query("e61_dossier_rules", "select o_orderkey, list_filter(['no_total', 'bad_status', 'no_priority'], lambda r: (r = 'no_total' and o_totalprice < 5000) or (r = 'bad_status' and o_orderstatus = 'P') or (r = 'no_priority' and o_orderpriority like '5%'))::varchar as problems from orders")
def e61(spark, d):
    rules = {"no_total": F.col("o_totalprice") < 5000, "bad_status": F.col("o_orderstatus") == "P", "no_priority": F.col("o_orderpriority").startswith("5")}
    return t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(an.problems(rules), ", "), F.lit("]")).alias("problems"))


@query("e64_review_manifest", "select o_custkey, string_agg(o_orderstatus || '=' || k, ',' order by o_orderstatus) as paths from (select o_custkey, o_orderstatus, min(o_orderkey) as k from orders group by 1, 2) group by 1")
def e64(spark, d):
    return an.review_manifest(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("e65_candidate_lookup", "select c_custkey, min(s_suppkey) as s_suppkey from customer join supplier on upper(trim(regexp_replace(c_name, '^Customer', 'Supplier'))) = upper(trim(s_name)) group by 1")
def e65(spark, d):
    return an.lookup_by_text(t(spark, d, "customer").withColumn("_text", F.regexp_replace("c_name", "^Customer", "Supplier")), t(spark, d, "supplier"), "_text", "c_custkey", "s_name", "s_suppkey")


@query("p02_best_hit", f"with {RANKS} select label, arg_min(run_, (rank, run_)) as best_row, min(rank) as rank from rk where rank is not null group by 1")
def p02(spark, d):
    return an.best_hit(ranks(spark, d), ["label"], "run_")


@query("p07_rescoring_toggles", "select mode, l_linestatus, round(avg(case mode when 'plain' then l_quantity when 'tax' then l_quantity * (1 + l_tax) else l_quantity * (1 - l_discount) end), 6) as mean_width from lineitem, (values ('plain'), ('tax'), ('discount')) v(mode) group by 1, 2")
def p07(spark, d):
    q = F.col("l_quantity")
    return an.rescoring_modes(t(spark, d, "lineitem"), ["l_linestatus"], {"plain": q, "tax": q * (1 + F.col("l_tax")), "discount": q * (1 - F.col("l_discount"))})


@query("p09_dictionary_filters", "select count(*) filter (where not contains(p_name, ',')) as no_comma, count(*) filter (where len(string_split(p_name, ' ')) > 1) as no_single, count(*) filter (where not regexp_matches(p_name, '(^| )[A-Za-z][.]?( |$)')) as no_initial, count(*) filter (where not regexp_matches(lower(p_name), '^(mr|mrs|dr) ')) as no_honorific from part")
def p09(spark, d):
    return an.dictionary_filters(t(spark, d, "part"), "p_name")


@query("p14_policy_evaluation", f"with {RANKS} select fam, pen, round(avg(1 / (coalesce(rank, 100) + pen)), 6) as score from rk, (values (0), (1), (5)) v(pen) group by 1, 2")
def p14(spark, d):
    return an.policy_scores(ranks(spark, d), ["fam"], "rank", [0, 1, 5])


@query("p18_displacement_audit", f"with {RANKS}, k as (select *, row_number() over (partition by label order by err, cand) as n from rk) select cand, count(*) as n from k where n = 1 group by 1 order by n desc, cand limit 20")
def p18(spark, d):
    return an.most_common(an.best_of(ranks(spark, d), ["label"], "cand", "err", ["cand"], "cand_"), "cand_", 20).withColumnRenamed("cand_", "cand")


@query("p19_rounded_bbox_join", L + "select b.doc_id, count(*) as n, count(*) filter (where b.font_size <> 10) as nondefault from box b join box c on b.doc_id = c.doc_id and b.page_index = c.page_index and round(b.x0, 2) = round(c.x0, 2) and round(b.y0, 2) = round(c.y0, 2) and round(b.x1, 2) = round(c.x1, 2) group by 1")
def p19(spark, d):
    b = layout.boxes(layout.load(spark, d))
    key = [F.round(c, 2).alias("r" + c) for c in ("x0", "y0", "x1")]
    k = ["doc_id", "page_index", "rx0", "ry0", "rx1"]
    return b.select("doc_id", "page_index", "font_size", *key).join(b.select("doc_id", "page_index", *key), k).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("font_size") != 10).alias("nondefault"))


@query("p23_target_profile", "select l_orderkey, l_linenumber, case when abs(l_tax - l_discount) <= 1e-9 then 'tie' when l_tax > l_discount then 'worse' else 'better' end as reason, case when l_tax >= l_discount and l_tax >= l_quantity / 500 then 'tax' when l_discount >= l_quantity / 500 then 'discount' else 'quantity' end as component from lineitem")
def p23(spark, d):
    reason, part = an.target_profile(F.col("l_tax"), F.col("l_discount"), {"tax": F.col("l_tax"), "discount": F.col("l_discount"), "quantity": F.col("l_quantity") / 500})
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"), part.alias("component"))


@query("p27_report_rows", L + EDGES_SQL + "select 'p' || page_index || ':' || line as place, doc_id, token_idx, coalesce(mode, 'unresolved') as mode, round(target_width, 2) as target_width from edge")
def p27(spark, d):
    return lines.load_edges(spark, d).select(F.concat(F.lit("p"), F.col("page_index").cast("string"), F.lit(":"), F.col("line").cast("string")).alias("place"), "doc_id", "token_idx", F.coalesce("mode", F.lit("unresolved")).alias("mode"), F.round("target_width", 2).alias("target_width"))


CODES = {"no_left": "left_edge is null", "no_right": "right_edge is null", "box_beside": "prev_box_x1 is not null or next_box_x0 is not null", "wide_gap": "target_width > 60",
    "selected_two_sided": "mode = 'two_sided'", "selected_left_only": "mode = 'left_only'", "selected_right_only": "mode = 'right_only'", "rejected_unresolved": "mode = 'unresolved'", "edges_inverted": "right_edge <= left_edge",
    "width_from_box": "left_edge is null or right_edge is null or right_edge <= left_edge", "width_from_edges": "right_edge > left_edge", "left_gap_negative": "box_x0 - left_edge < 0", "right_gap_negative": "right_edge - box_x1 < 0",
    "left_gap_wide": "box_x0 - left_edge > 18", "right_gap_wide": "right_edge - box_x1 > 18", "seed_left": "box_x0 - left_edge <= right_edge - box_x1", "seed_right": "box_x0 - left_edge > right_edge - box_x1",
    "previous_box_adjacent": "box_x0 - prev_box_x1 <= 18", "next_box_adjacent": "next_box_x0 - box_x1 <= 18", "span_wider_than_box": "target_width > box_x1 - box_x0 + 1.0::double", "span_narrower_than_box": "target_width < box_x1 - box_x0 - 1.0::double",
    "box_narrow": "box_x1 - box_x0 < 20", "box_wide": "box_x1 - box_x0 >= 100", "blocked_left": "left_edge is null and prev_box_x1 is not null", "blocked_right": "right_edge is null and next_box_x0 is not null"}


@query("m15_reason_codes", L + EDGES_SQL + ", cd as (select doc_id, token_idx, unnest([" + ", ".join(f"case when {w} then '{k}' end" for k, w in CODES.items()) + "]) as code from edge) select * from cd where code is not null")
def m15(spark, d):
    return lines.load_edges(spark, d).select("doc_id", "token_idx", F.explode(ty.reason_codes(ty.anchor_codes())).alias("code"))


@query("o04_line_anchor", L + """, c as (select b.doc_id, b.token_idx, r.token, r.x0, r.x1, b.x0 as bx0, b.x1 as bx1, abs((r.y0 + r.y1) / 2 - (b.y0 + b.y1) / 2) as off from box b join run r on b.doc_id = r.doc_id and b.page_index = r.page_index and r.line between b.line - 1 and b.line + 1
  where trim(r.token) <> '' and (abs(round((r.y0 + r.y1) / 2 / 2) - round((b.y0 + b.y1) / 2 / 2)) <= 1 or abs((r.y0 + r.y1) / 2 - (b.y0 + b.y1) / 2) <= 8) and r.x0 <= b.x0),
 f as (select * from c where bx0 - x1 <= 24 and x0 <= bx1 + 52), k as (select *, row_number() over (partition by doc_id, token_idx order by x0, off, token) as n from f) select doc_id, token_idx, token as text, round(x0, 4) as x0 from k where n = 1""")
def o04(spark, d):
    tok = layout.load(spark, d)
    b = layout.boxes(tok).select("doc_id", "page_index", "token_idx", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), ((F.col("y0") + F.col("y1")) / 2).alias("target_y"), F.explode(F.sequence(F.col("line") - 1, F.col("line") + 1)).alias("line"))
    r = layout.runs(tok).select("doc_id", "page_index", "line", F.col("token").alias("text"), "x0", "y0", "x1", "y1")
    c = b.join(r, ["doc_id", "page_index", "line"]).withColumn("role", F.when(F.col("x0") <= F.col("bx0"), "left").otherwise("right"))
    return context.line_anchor(c, ["doc_id", "token_idx"], "prefix").select("doc_id", "token_idx", "text", F.round("x0", 4).alias("x0"))


@query("o06_overlay_width", L + f", u as (select distinct token from tok where token <> '' and regexp_matches(token, '^[ -~]+$')) select token, round(case when len(list_filter(string_split(token, ''), lambda c: c <> '' and ascii(c) between 32 and 99)) > 0 then list_sum(list_transform(list_filter(string_split(token, ''), lambda c: c <> '' and ascii(c) between 32 and 99), lambda c: ({HELVETICA})[ascii(c) - 31])) * 11 / 1000::double else 11 * 0.6::double * length(token) end * 0.9::double, 4) as width from u")
def o06(spark, d):
    u = layout.words(spark.read.parquet(f"{d}/documents.parquet")).where("token <> ''").where(F.rlike("token", F.lit("^[ -~]+$"))).select("token").distinct()
    table = F.array(*[F.lit(float(x)) for x in HELVETICA[:68]])
    return u.select("token", F.round(context.overlay_width(F.col("token"), F.lit(11.0), F.lit(90.0), table, F.lit(32)), 4).alias("width"))


@query("v03_rect_pixels", L + "select doc_id, token_idx, greatest(0, floor(x0 * 200 / 72))::int as px0, least(1700, ceil(x1 * 200 / 72))::int as px1 from box")
def v03(spark, d):
    b = layout.boxes(layout.load(spark, d))
    return b.select("doc_id", "token_idx", F.greatest(F.lit(0), F.floor(F.col("x0") * 200 / 72)).cast("int").alias("px0"), F.least(F.lit(1700), F.ceil(F.col("x1") * 200 / 72)).cast("int").alias("px1"))


__all__ = ["ORACLE_SQL", "QUERIES", "g"]
