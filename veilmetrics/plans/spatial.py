"""Queries on boxes and visible words: detection predicates, context, anchors, neighbours."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import context, detection, measure
from ..sources import layout, lines
from .flagship import EDGES_SQL

L = layout.SQL
QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _tok(spark, d):
    return layout.load(spark, d)


def _lines(spark, d):
    return lines.line_anchors(spark.read.parquet(f"{d}/documents.parquet"))


def _box(spark, d):
    return layout.boxes(_tok(spark, d))


@query("d05_rect_score", L + """select score, count(*) as n, round(sum(x1 - x0), 3) as width from (select *, case when x1 - x0 <= 0 or y1 - y0 <= 0 then 0.0::double else
  (((x1-x0)*(y1-y0) >= 25)::int + ((x1-x0)*(y1-y0) >= 200)::int + ((x1-x0)/(y1-y0) >= 2)::int + ((x1-x0)/(y1-y0) >= 6)::int + ((x1-x0) >= 20 and (y1-y0) >= 6)::int) / 5.0::double end as score from box) group by score""")
def d05(spark, d):
    return _box(spark, d).withColumn("score", g.redaction_score(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).groupBy("score").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") - F.col("x0")), 3).alias("width"))


@query("d06_near_full_page", L + """, p as (select doc_id, page_index, max(x1) - min(x0) as w, max(y1) - min(y0) as h from tok group by 1, 2)
select doc_id, page_index, round(w, 4) as w, round(h, 4) as h, (w >= 500 and h >= 650) or (w >= 612 * 0.9 and h >= 792 * 0.9) as near_full from p""")
def d06(spark, d):
    p = _tok(spark, d).groupBy("doc_id", "page_index").agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    return p.select("doc_id", "page_index", F.round("w", 4).alias("w"), F.round("h", 4).alias("h"), g.near_full_page("w", "h").alias("near_full"))


@query("d07_fill_black", """with f as (select event_id, (event_id % 5) / 4.0::double as c, (event_id % 3) / 2.0::double as m, (event_id % 2)::double as y, (event_id % 4) / 3.0::double as k from events)
select black, count(*) as n from (select greatest((1-least(1,c+k)), (1-least(1,m+k)), (1-least(1,y+k))) <= 0.01 as black from f) group by black""")
def d07(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    c, m, y, k = F.col("event_id") % 5 / 4, F.col("event_id") % 3 / 2, (F.col("event_id") % 2).cast("double"), F.col("event_id") % 4 / 3
    return e.select(detection.is_black(*detection.cmyk_to_rgb(c, m, y, k)).alias("black")).groupBy("black").agg(F.count("*").alias("n"))


@query("d15_pixel_round_trip", L + """, p as (select doc_id, token_idx, floor(greatest(0, x0) * 96 / 72)::int as px0, ceil(least(612, x1) * 96 / 72)::int as px1, floor((792 - least(792, y1)) * 96 / 72)::int as py0, ceil((792 - greatest(0, y0)) * 96 / 72)::int as py1 from box)
select doc_id, token_idx, px0, py0, px1, py1, round(px0 * 72 / 96.0::double, 4) as rx0, round(792 - py1 * 72 / 96.0::double, 4) as ry0, round(px1 * 72 / 96.0::double, 4) as rx1, round(792 - py0 * 72 / 96.0::double, 4) as ry1 from p""")
def d15(spark, d):
    p = _box(spark, d).select("doc_id", "token_idx", detection.rect_to_pixels("x0", "y0", "x1", "y1", 96).alias("p")).select("doc_id", "token_idx", "p.*")
    return p.select("*", detection.pixels_to_rect("px0", "py0", "px1", "py1", 96).alias("r")).select("doc_id", "token_idx", "px0", "py0", "px1", "py1", *[F.round(f"r.{k}", 4).alias("r" + k) for k in ("x0", "y0", "x1", "y1")])


@query("d19_union_dedupe", L + """, u as (select 0 as src, 'drawn_rect' as kind, * from box union all by name select 1 as src, case when token_idx % 2 = 0 then 'drawn_rect' else 'raster_dark_region' end as kind, * from det),
k as (select *, row_number() over (partition by doc_id, page_index, round(x0, 2), round(y0, 2), round(x1, 2), round(y1, 2), kind order by src, token_idx) as n from u)
select doc_id, page_index, token_idx, src, kind from k where n = 1""")
def d19(spark, d):
    b = _box(spark, d)
    det = layout.detected(b).withColumn("kind", F.when(F.col("token_idx") % 2 == 0, "drawn_rect").otherwise("raster_dark_region"))
    u = detection.union_detectors([b.withColumn("kind", F.lit("drawn_rect")), det])
    return detection.dedupe_keep_first(u, ["doc_id", "page_index"], 2, ["src", "token_idx"]).select("doc_id", "page_index", "token_idx", F.col("src").cast("int").alias("src"), "kind")


@query("d18_mode_gate", L + """, u as (select 0 as src, doc_id from box union all select 1, doc_id from det where token_idx % 2 = 0) select src, count(*) as n, count(distinct doc_id) as docs from u group by src""")
def d18(spark, d):
    b = _box(spark, d)
    sources = {"annotations": b.limit(0), "drawn": b, "raster": layout.detected(b).where("token_idx % 2 = 0")}
    u = detection.gated(sources, mode="drawn", raster=True)
    return u.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("d20_report", L + "select doc_id, page_index, count(*) as n, round(min(x0), 4) as first_x0, round(max(x1), 4) as last_x1 from box group by doc_id, page_index")
def d20(spark, d):
    return detection.page_counts(_box(spark, d))


@query("d14_histogram_percentile", """with h as (select l_returnflag as k, l_quantity::int as v, count(*) as n from lineitem group by 1, 2),
c as (select *, sum(n) over (partition by k order by v) as cum, sum(n) over (partition by k) as total from h)
select k, min(v) filter (where cum >= greatest(1, ceil(total * 0.5))) as p50, min(v) filter (where cum >= greatest(1, ceil(total * 0.95))) as p95 from c group by k""")
def d14(spark, d):
    h = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("n"))
    return detection.histogram_percentiles(h, "k", "v", "n", {"p50": 0.5, "p95": 0.95})


@query("d16_two_pass_prune", L + """, cand as (select distinct doc_id, page_index from box where x1 - x0 >= 40), hi as (select b.* from box b semi join cand using (doc_id, page_index)),
ok as (select doc_id, page_index, count(*) as n from hi where doc_id % 7 <> 0 group by 1, 2), lo as (select doc_id, page_index, count(*) as n from box where x1 - x0 >= 40 group by 1, 2)
select doc_id, page_index, coalesce(ok.n, lo.n) as n, case when ok.n is null then 'prepass' else 'highpass' end as source from lo left join ok using (doc_id, page_index)""")
def d16(spark, d):
    b = _box(spark, d)
    return detection.two_pass(b, cheap=F.col("x1") - F.col("x0") >= 40, costly=F.col("doc_id") % 7 != 0)


@query("d17_reject_guard", L + """, c as (select doc_id, page_index, count(*) as candidates, count(*) filter (where x1 - x0 >= 60) as accepted from box group by 1, 2) select *, case when candidates > 0 and accepted = 0 then 'all_rejected' else 'ok' end as status from c""")
def d17(spark, d):
    return detection.reject_guard(_box(spark, d), ["doc_id", "page_index"], F.col("x1") - F.col("x0") >= 60)


@query("j02_line_bucket", L + "select doc_id, page_index, round((y0 + y1) / 4)::bigint as bucket, count(*) as n from run group by 1, 2, 3")
def j02(spark, d):
    return layout.runs(_tok(spark, d)).groupBy("doc_id", "page_index", context.line_bucket("y0", "y1").alias("bucket")).agg(F.count("*").alias("n"))


J01 = """, j as (select b.doc_id, b.token_idx, b.x0 as bx0, b.x1 as bx1, (b.y0 + b.y1) / 2 as bcy, r.token_idx as rt, r.token, r.x0, r.x1, (r.y0 + r.y1) / 2 as cy, round((r.y0 + r.y1) / 4)::bigint as bucket
  from box b join run r on b.doc_id = r.doc_id and b.page_index = r.page_index
  and (least(r.y1, b.y1 + 2) - greatest(r.y0, b.y0 - 2) > 0 or abs((r.y0 + r.y1) / 2 - (b.y0 + b.y1) / 2) <= 18)),
l as (select doc_id, token_idx, bucket, max(case when x0 < bx0 then struct_pack(x0 := x0, x1 := x1, t := rt) end) as bef, min(case when x1 > bx1 then struct_pack(x0 := x0, x1 := x1, t := rt) end) as aft,
  sum(greatest(0, least(x1, bx1) - greatest(x0, bx0))) as ov, avg(cy) as lcy, any_value(bx0) as bx0, any_value(bx1) as bx1, any_value(bcy) as bcy, count(*) as n from j group by 1, 2, 3),
s as (select *, case when bef is not null and aft is not null then case when ov > 20 then 2 else 0 end when bef is not null then 1 else 2 end as context_rank, round(abs(lcy - bcy) * 100)::bigint as y_rank,
  coalesce(round(greatest(0, bx0 - bef.x1) * 100), 100000)::bigint as before_gap, coalesce(round(greatest(0, aft.x0 - bx1) * 100), 100000)::bigint as after_gap from l
  where (bef is not null or aft is not null) and not (ov > 20 and bef is null)),
best as (select *, row_number() over (partition by doc_id, token_idx order by context_rank, y_rank, before_gap, after_gap, bucket) as k from s)
"""


@query("j01_context_band_join", L + J01 + "select doc_id, count(*) as pairs, count(distinct token_idx) as boxes from j group by doc_id")
def j01(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.sum("n").alias("pairs"), F.countDistinct("token_idx").alias("boxes"))


@query("j03_before_after_anchor", L + J01 + "select doc_id, token_idx, bucket, bef.t as before_token, aft.t as after_token, n from l")
def j03(spark, d):
    return _lines(spark, d).select("doc_id", "token_idx", "bucket", F.col("bef.t").alias("before_token"), F.col("aft.t").alias("after_token"), "n")


@query("j04_best_context_line", L + J01 + "select doc_id, token_idx, bucket, context_rank, y_rank, before_gap, after_gap from best where k = 1")
def j04(spark, d):
    return context.best_line(_lines(spark, d)).select("doc_id", "token_idx", "bucket", "context_rank", "y_rank", "before_gap", "after_gap")


@query("j05_phrase_growth", L + J01 + """, nb as (select doc_id, token_idx, bucket, rt, token, x0, x1, lag(token) over w as pt, x0 - lag(x1) over w as pg, lead(token) over w as nt, lead(x0) over w - x1 as ng from j window w as (partition by doc_id, token_idx, bucket order by x0, x1, rt))
select b.doc_id, b.token_idx, concat_ws(' ', case when l.pg <= 30 then l.pt end, l.token) as before, concat_ws(' ', r.token, case when r.ng <= 30 then r.nt end) as after from best b
 left join nb l on l.doc_id = b.doc_id and l.token_idx = b.token_idx and l.bucket = b.bucket and l.rt = b.bef.t left join nb r on r.doc_id = b.doc_id and r.token_idx = b.token_idx and r.bucket = b.bucket and r.rt = b.aft.t where b.k = 1""")
def j05(spark, d):
    return context.best_line(_lines(spark, d)).select("doc_id", "token_idx", "before", "after")


@query("j06_line_cluster", L + """, ln as (select doc_id, page_index, line, count(*) as n, max(y1) as y from run group by 1, 2, 3), lag_ as (select *, lag(y) over w as py, lead(y) over w as ny from ln window w as (partition by doc_id, page_index order by line))
select doc_id, page_index, line, n, coalesce(py - y <= 18, false) as joins_above, coalesce(y - ny <= 18, false) as joins_below from lag_""")
def j06(spark, d):
    return context.line_cluster(layout.runs(_tok(spark, d)))


@query("j07_context_spans", L + J01 + """, sp as (select distinct doc_id, token_idx, case when x1 <= bx0 + 0.5 then 'left' when x0 >= bx1 - 0.5 then 'right' else 'center' end as role, round(x0, 1) as x0, round(x1, 1) as x1, bucket, rt, token from j),
  k as (select *, row_number() over (partition by doc_id, token_idx order by bucket desc, x0, x1, rt) as n from sp)
select doc_id, token_idx, count(*) filter (where role = 'left') as n_left, count(*) filter (where role = 'right') as n_right, count(*) filter (where role = 'center') as n_center, max(n) as n_all from k where n <= 48 group by 1, 2""")
def j07(spark, d):
    return lines.span_counts(spark.read.parquet(f"{d}/documents.parquet"), limit=48)


@query("j08_underlying_text", L + """select b.doc_id, b.token_idx, count(t.token_idx) as hits, min(t.token) as first_text from det b left join tok t on t.doc_id = b.doc_id and t.page_index = b.page_index and t.y0 < b.y1 and t.y1 > b.y0 and t.x0 < b.x1 and t.x1 > b.x0 group by 1, 2""")
def j08(spark, d):
    t = _tok(spark, d)
    return context.attach_text(layout.detected(layout.boxes(t)), t)


@query("j09_line_buckets", L + """, r as (select doc_id, page_index, y1, x0, x1 from run), o as (select *, case when abs(y1 - lag(y1) over w) <= 3 and x0 - lag(x1) over w <= 250 then 0 else 1 end as fresh from r window w as (partition by doc_id, page_index order by y1, x0)),
 i as (select *, sum(fresh) over (partition by doc_id, page_index order by y1, x0 rows unbounded preceding) as bucket from o) select doc_id, page_index, bucket::bigint as bucket, count(*) as n, round(min(x0), 4) as x0, round(max(x1), 4) as x1 from i group by 1, 2, 3""")
def j09(spark, d):
    return context.greedy_lines(layout.runs(_tok(spark, d))).groupBy("doc_id", "page_index", "bucket").agg(F.count("*").alias("n"), F.round(F.min("x0"), 4).alias("x0"), F.round(F.max("x1"), 4).alias("x1"))


@query("j10_box_validity", L + """select reason, count(*) as n from (select case when x1 - x0 < 1 or y1 - y0 < 1 then 'edge' when (x1 - x0) * (y1 - y0) < 4 then 'area' when x0 < 0 or x1 > 612 or y0 < 0 or y1 > 792 then 'outside' when (x1 - x0) * (y1 - y0) / (612 * 792) >= 0.9 then 'coverage' else 'ok' end as reason from det) group by reason""")
def j10(spark, d):
    return layout.detected(_box(spark, d)).select(detection.invalid_reason("x0", "y0", "x1", "y1").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("j11_duplicate_boxes", L + """, u as (select 0 as src, * from box union all by name select 1 as src, * from det), k as (select *, row_number() over (partition by doc_id, page_index, round(x0, 4), round(y0, 4), round(x1, 4), round(y1, 4) order by src, token_idx) as n from u) select doc_id, src, count(*) as kept from k where n = 1 group by 1, 2""")
def j11(spark, d):
    b = _box(spark, d)
    u = detection.union_detectors([b, layout.detected(b)]).withColumn("kind", F.lit("x"))
    return detection.dedupe_keep_first(u, ["doc_id", "page_index"], 4, ["src", "token_idx"]).groupBy("doc_id", F.col("src").cast("int").alias("src")).agg(F.count("*").alias("kept"))


GREEDY = """, o as (select *, case when abs(y1 - lag(y1) over w) <= 3 and x0 - lag(x1) over w <= 250 then 0 else 1 end as fresh from run window w as (partition by doc_id, page_index order by y1, x0)),
 greedy as materialized (select *, sum(fresh) over (partition by doc_id, page_index order by y1, x0 rows unbounded preceding)::bigint as bucket from o)"""
LN = GREEDY + """, ln as (select doc_id, page_index, bucket, max(y1) as baseline, min(y0) as ly0, max(y1) as ly1 from greedy group by 1, 2, 3)
, bl as (select b.doc_id, b.token_idx, ln.bucket, greatest(0, least(b.y1, ly1) - greatest(b.y0, ly0)) as ov, abs(baseline - b.y1) as delta from box b join ln on b.doc_id = ln.doc_id and b.page_index = ln.page_index where least(b.y1, ly1) - greatest(b.y0, ly0) > 0 or abs(baseline - b.y1) <= 3)
"""


@query("j12_box_line_join", L + LN + "select doc_id, token_idx, bucket, rank::int as rank from (select *, row_number() over (partition by doc_id, token_idx order by round(ov * 10000) desc, round(delta * 10000), bucket) as rank from bl)")
def j12(spark, d):
    t = _tok(spark, d)
    return context.ranked_lines(layout.boxes(t), layout.runs(t)).select("doc_id", "token_idx", "bucket", "rank")


REL = """, rel as materialized (select b.doc_id, b.token_idx, r.token_idx as rt, r.x1 - r.x0 as w, abs(r.x1 - b.x0) as gap, greatest(0, r.x1 - b.x0) as depth,
  case when r.x1 <= b.x0 then 0 when r.x0 < b.x0 then case when r.x1 - b.x0 <= 3 then 1 else 2 end when r.x0 < b.x1 then 2 else 3 end as relation from det b join run r on b.doc_id = r.doc_id and b.line = r.line)
"""


@query("j13_side_relation", L + REL + "select relation, count(*) as n from rel group by relation")
def j13(spark, d):
    t = _tok(spark, d)
    return context.side_relations(layout.detected(layout.boxes(t)), layout.runs(t)).groupBy("relation").agg(F.count("*").alias("n"))


@query("j14_ranked_runs", L + REL + "select doc_id, token_idx, rt, rank::int as rank from (select *, row_number() over (partition by doc_id, token_idx order by relation, round(gap * 10000), round(depth * 10000), round(w * 10000), rt) as rank from rel where relation < 2) where rank <= 3")
def j14(spark, d):
    t = _tok(spark, d)
    return context.ranked_runs(context.side_relations(layout.detected(layout.boxes(t)), layout.runs(t))).where("rank <= 3").select("doc_id", "token_idx", "rt", "rank")


@query("j16_boundary_punctuation", L + "select count(*) filter (where regexp_matches(token, '[A-Za-z0-9]')) as alnum, count(*) filter (where not regexp_matches(token, '[A-Za-z0-9]')) as other, count(*) filter (where regexp_matches(token, '^[.,;:!?]+$')) as punctuation from run")
def j16(spark, d):
    m = lambda p: F.count_if(F.rlike("token", F.lit(p)))
    return layout.runs(_tok(spark, d)).agg(m("[A-Za-z0-9]").alias("alnum"), F.count_if(~F.rlike("token", F.lit("[A-Za-z0-9]"))).alias("other"), m("^[.,;:!?]+$").alias("punctuation"))


@query("j17_neighbour_growth", L + GREEDY + r""", lg as (select *, x0 - lag(x1) over w as gap, lag(token) over w as pt, abs(y1 - lag(y1) over w) <= 3 and x0 - lag(x1) over w between -0.5 and 18 and font_size = lag(font_size) over w as same from greedy window w as (partition by doc_id, page_index, bucket order by x0, x1, token_idx)),
 jn as (select *, case when same and regexp_matches(right(pt, 1), '^[\p{L}\p{N},]$') and regexp_matches(left(token, 1), '^[\p{L}\p{N}(]$') and gap >= 0.25 then ' ' else '' end as sep, sum(case when same then 0 else 1 end) over (partition by doc_id, page_index, bucket order by x0, x1, token_idx rows unbounded preceding) as isl from lg)
select doc_id, page_index, arg_min(token_idx, (x0, x1, token_idx)) as first, count(*) as n, string_agg(sep || token, '' order by x0, x1, token_idx) as text, round(min(x0), 4) as x0, round(max(x1), 4) as x1 from jn group by doc_id, page_index, bucket, isl""")
def j17(spark, d):
    return context.joined_runs(layout.runs(_tok(spark, d))).withColumns({c: F.round(c, 4) for c in ("x0", "x1")})


J18 = REL + """, rgt as materialized (select b.doc_id, b.token_idx, r.token_idx as rt, r.x0 - b.x1 as gap from det b join run r on b.doc_id = r.doc_id and b.line = r.line where r.x0 >= b.x1),
 l2 as materialized (select doc_id, token_idx, rt, gap, row_number() over (partition by doc_id, token_idx order by round(gap * 10000), rt) as k from rel where relation = 0), r2 as materialized (select *, row_number() over (partition by doc_id, token_idx order by round(gap * 10000), rt) as k from rgt),
 pr as (select l.doc_id, l.token_idx, l.rt as left_rt, r.rt as right_rt, round((l.gap + r.gap) * 10000)::bigint as gap_sum, round(greatest(l.gap, r.gap) * 10000)::bigint as gap_max from l2 l join r2 r using (doc_id, token_idx))
"""


@query("j18_pair_product", L + J18 + "select doc_id, token_idx, left_rt, right_rt from pr")
def j18(spark, d):
    t = _tok(spark, d)
    return context.anchor_pairs(layout.detected(layout.boxes(t)), layout.runs(t)).select("doc_id", "token_idx", "left_rt", "right_rt")


@query("j20_pair_ordering", L + J18 + "select doc_id, token_idx, left_rt, right_rt, gap_sum from (select *, row_number() over (partition by doc_id, token_idx order by gap_sum, gap_max, left_rt desc, right_rt) as k from pr) where k = 1")
def j20(spark, d):
    t = _tok(spark, d)
    return context.best_pair(context.anchor_pairs(layout.detected(layout.boxes(t)), layout.runs(t))).select("doc_id", "token_idx", "left_rt", "right_rt", "gap_sum")


@query("j22_anchor_modes", L + EDGES_SQL + "select mode, count(*) as n, count(distinct doc_id) as docs from edge group by mode")
def j22(spark, d):
    return lines.load_edges(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("j23_seed_side", L + EDGES_SQL + """select doc_id, token_idx, case when left_edge is null and right_edge is null then null when right_edge is null then 'left' when left_edge is null then 'right'
  when round(abs(box_x0 - left_edge) * 10000) <= round(abs(right_edge - box_x1) * 10000) then 'left' else 'right' end as seed from edge""")
def j23(spark, d):
    q = lambda c: g.quantise(F.abs(c))
    left = F.when(F.col("left_edge").isNull() & F.col("right_edge").isNull(), None).when(F.col("right_edge").isNull(), "left").when(F.col("left_edge").isNull(), "right")
    return lines.load_edges(spark, d).select("doc_id", "token_idx", left.when(q(F.col("box_x0") - F.col("left_edge")) <= q(F.col("right_edge") - F.col("box_x1")), "left").otherwise("right").alias("seed"))


@query("j24_usable_edges", L + EDGES_SQL + "select doc_id, token_idx, mode, round(left_edge, 4) as left_edge, round(right_edge, 4) as right_edge, round(target_width, 4) as target_width from edge")
def j24(spark, d):
    return lines.load_edges(spark, d).select("doc_id", "token_idx", "mode", *[F.round(c, 4).alias(c) for c in ("left_edge", "right_edge", "target_width")])


@query("j25_row_bias", L + """, nx as (select doc_id, line, x0 - lag(x1) over (partition by doc_id, line order by token_idx) - font_size * 0.278::double as res from run),
 s as (select doc_id, line, list_sort(list(round(res, 4) + 0.0::double)) as a from nx where res is not null group by 1, 2)
select doc_id, line, med as bias, least(8, greatest(3.5, list_sort(list_transform(a, lambda x: round(abs(x - med), 4)))[floor(len(a) * 0.75)::int + 1]))::double as tolerance from (select doc_id, line, a, a[floor(len(a) * 0.5)::int + 1] as med from s)""")
def j25(spark, d):
    return context.row_bias(layout.runs(_tok(spark, d)))


@query("j26_neighbours", L + """select doc_id, token_idx, count(*) over p as line_count, row_number() over w - 1 as line_order, lag(token_idx) over w as prev_box, round(x0 - lag(x1) over w, 4) as prev_gap, lead(token_idx) over w as next_box, round(lead(x0) over w - x1, 4) as next_gap
from box window p as (partition by doc_id, line), w as (partition by doc_id, line order by x0, x1, token_idx)""")
def j26(spark, d):
    return context.neighbours(_box(spark, d))


@query("j27_font_model", L + """, f as (select distinct font_size, case when font_size = 11 then 100.04 else 99.96 end as tz from tok where font_size < 12) select b.doc_id, b.font_size, count(*) as n, round(max(f.tz), 1) as h_scale, count(f.tz) as with_model from box b left join f using (font_size) group by 1, 2""")
def j27(spark, d):
    t = _tok(spark, d)
    model = t.where("font_size < 12").select("font_size").distinct().withColumn("tz", F.when(F.col("font_size") == 11, F.lit(100.04)).otherwise(F.lit(99.96)))
    return layout.boxes(t).join(F.broadcast(model), "font_size", "left").groupBy("doc_id", "font_size").agg(F.count("*").alias("n"), F.round(F.max("tz"), 1).alias("h_scale"), F.count("tz").alias("with_model"))


@query("j28_boundary_space", L + "select font_size, round(278 * font_size / 1000.0::double, 4) as space_pt, count(*) as n from run group by 1")
def j28(spark, d):
    return layout.runs(_tok(spark, d)).groupBy("font_size").agg(F.count("*").alias("n")).withColumn("space_pt", F.round(F.lit(278) * F.col("font_size") / 1000, 4))


UNEVEN = """, un as (select doc_id, page_index, token_idx, x0, x1, y0, y1 + token_idx % 5 * 3 as y1 from box)"""


@query("o01_dense_rows", L + UNEVEN + """ select distinct a.doc_id, a.token_idx from un a join un b on a.doc_id = b.doc_id and a.page_index = b.page_index and a.token_idx <> b.token_idx
 where least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * least(a.y1 - a.y0, b.y1 - b.y0) and greatest(b.x0 - a.x1, a.x0 - b.x1, 0) <= 96""")
def o01(spark, d):
    return detection.dense_boxes(_box(spark, d).withColumn("y1", F.col("y1") + F.col("token_idx") % 5 * 3))  # of uneven height, so that lines meet


@query("o02_dense_height", L + "select doc_id, line, round(max(y1 - y0), 4) as height, count(*) as n from box group by 1, 2 having count(*) > 1")
def o02(spark, d):
    return _box(spark, d).groupBy("doc_id", "line").agg(F.round(F.max(F.col("y1") - F.col("y0")), 4).alias("height"), F.count("*").alias("n")).where("n > 1")


@query("o03_run_pick", L + """, p as (select b.doc_id, b.token_idx, r.token_idx as rt, least(r.y1, b.y1) - greatest(r.y0, b.y0) as ov, abs(r.x0 - b.x0) as dist from det b join run r on b.doc_id = r.doc_id and b.page_index = r.page_index and r.y0 < b.y1 and b.y0 < r.y1)
select doc_id, token_idx, rt from (select *, row_number() over (partition by doc_id, token_idx order by round(ov * 10000) desc, round(dist * 10000), rt) as k from p) where k = 1""")
def o03(spark, d):
    t = _tok(spark, d)
    return context.nearest_run(layout.detected(layout.boxes(t)), layout.runs(t))


@query("o07_overlay_layout", L + "select doc_id, token_idx, round(greatest(x0, least(x1, (x0 + x1) / 2 - length(target) * 0.3 * font_size)), 4) as text_x, round(y0 + (y1 - y0 - font_size) / 2, 4) as text_y from box")
def o07(spark, d):
    mid = (F.col("x0") + F.col("x1")) / 2 - F.length("target") * F.lit(0.3) * F.col("font_size")
    return _box(spark, d).select("doc_id", "token_idx", F.round(F.greatest(F.col("x0"), F.least(F.col("x1"), mid)), 4).alias("text_x"), F.round(F.col("y0") + (F.col("y1") - F.col("y0") - F.col("font_size")) / 2, 4).alias("text_y"))


@query("v02_search_window", L + "select doc_id, token_idx, round(greatest(0, x0 - 200), 4) as wx0, round(least(612, x1 + 200), 4) as wx1, round(greatest(0, y0 - greatest(18, 1.5 * (y1 - y0))), 4) as wy0, round(least(792, y1 + greatest(18, 1.5 * (y1 - y0))), 4) as wy1 from box")
def v02(spark, d):
    pad = F.greatest(F.lit(18.0), F.lit(1.5) * (F.col("y1") - F.col("y0")))
    return _box(spark, d).select("doc_id", "token_idx", F.round(F.greatest(F.lit(0.0), F.col("x0") - 200), 4).alias("wx0"), F.round(F.least(F.lit(612.0), F.col("x1") + 200), 4).alias("wx1"), F.round(F.greatest(F.lit(0.0), F.col("y0") - pad), 4).alias("wy0"), F.round(F.least(F.lit(792.0), F.col("y1") + pad), 4).alias("wy1"))


@query("v07_nearest_span", L + """, p as (select b.doc_id, b.token_idx, r.token_idx as rt, b.x0 - r.x1 as gap, least(b.y1, r.y1) - greatest(b.y0, r.y0) as vov, (r.x1 - r.x0) * (r.y1 - r.y0) as area, r.x0, r.y0 from box b join run r on b.doc_id = r.doc_id and b.line = r.line where r.x1 <= b.x0)
select doc_id, token_idx, rt from (select *, row_number() over (partition by doc_id, token_idx order by round(gap * 10000), round(vov * 10000) desc, round(area * 10000) desc, x0, y0) as k from p) where k = 1""")
def v07(spark, d):
    t = _tok(spark, d)
    return context.nearest_left_span(layout.boxes(t), layout.runs(t))


@query("v09_flags", L + EDGES_SQL + "select left_edge is null and right_edge is null as visually_empty, prev_box_x1 is not null or next_box_x0 is not null as neighbour_available, target_width > 1.5 * (box_x1 - box_x0) as likely_hidden, count(*) as n from edge group by 1, 2, 3")
def v09(spark, d):
    e = lines.load_edges(spark, d)
    flags = {"visually_empty": F.col("left_edge").isNull() & F.col("right_edge").isNull(), "neighbour_available": F.col("prev_box_x1").isNotNull() | F.col("next_box_x0").isNotNull(), "likely_hidden": F.col("target_width") > F.lit(1.5) * (F.col("box_x1") - F.col("box_x0"))}
    return e.groupBy(*[v.alias(k) for k, v in flags.items()]).agg(F.count("*").alias("n"))


@query("v10_width_deltas", L + EDGES_SQL + "select doc_id, token_idx, round(target_width - (box_x1 - box_x0), 4) as width_delta, round(left_edge - box_x0, 4) as left_delta, round(right_edge - box_x1, 4) as right_delta from edge")
def v10(spark, d):
    return lines.load_edges(spark, d).select("doc_id", "token_idx", F.round(F.col("target_width") - (F.col("box_x1") - F.col("box_x0")), 4).alias("width_delta"), F.round(F.col("left_edge") - F.col("box_x0"), 4).alias("left_delta"), F.round(F.col("right_edge") - F.col("box_x1"), 4).alias("right_delta"))


@query("v11_visual_summary", L + EDGES_SQL + "select count(*) as rows_, count(*) filter (where mode = 'two_sided') as two_sided, count(*) filter (where left_edge is null) as no_left, count(*) filter (where right_edge is null) as no_right, round(avg(target_width), 4) as mean_target from edge")
def v11(spark, d):
    return lines.load_edges(spark, d).agg(F.count("*").alias("rows_"), F.count_if(F.col("mode") == "two_sided").alias("two_sided"), F.count_if(F.col("left_edge").isNull()).alias("no_left"), F.count_if(F.col("right_edge").isNull()).alias("no_right"), F.round(F.avg("target_width"), 4).alias("mean_target"))


@query("v12_inner_join", L + EDGES_SQL + "select e.doc_id, count(*) as n from edge e join det d using (doc_id, token_idx) group by 1")
def v12(spark, d):
    t = _tok(spark, d)
    return lines.load_edges(spark, d).select("doc_id", "token_idx").join(layout.detected(layout.boxes(t)).select("doc_id", "token_idx"), ["doc_id", "token_idx"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("m12_boxes_left_join", L + EDGES_SQL + ", er as materialized (select doc_id, token_idx, mode, target_width from edge where mode <> 'unresolved') select b.doc_id, b.token_idx, coalesce(e.mode, 'unresolved') as mode, round(coalesce(e.target_width, b.x1 - b.x0), 4) as target_width from box b left join er e on b.doc_id = e.doc_id and b.token_idx = e.token_idx")
def m12(spark, d):
    e = lines.load_edges(spark, d).where("mode <> 'unresolved'").select("doc_id", "token_idx", "mode", "target_width")
    return _box(spark, d).join(e, ["doc_id", "token_idx"], "left").select("doc_id", "token_idx", F.coalesce("mode", F.lit("unresolved")).alias("mode"), F.round(F.coalesce("target_width", F.col("x1") - F.col("x0")), 4).alias("target_width"))


__all__ = ["ORACLE_SQL", "QUERIES", "Window"]
