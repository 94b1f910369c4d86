"""Queries of the evaluation layer: detection quality, rank metrics, signals, what-if scripts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import analysis as an
from ..operators import evaluate as ev
from ..operators import measure, names
from ..sources import layout, lines
from .dictionary import VARIANTS, normal
from .flagship import EDGES_SQL

L = layout.SQL
LR = L.replace("with lay_w", "with recursive lay_w", 1)
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


def boxes(spark, d):
    b = layout.boxes(layout.load(spark, d))
    return b, layout.detected(b)


PAIRS = """, pr0 as (select a.doc_id, a.line, a.token_idx as t, b.token_idx as f, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter,
 (a.x1 - a.x0) * (a.y1 - a.y0) as aa, (b.x1 - b.x0) * (b.y1 - b.y0) as ba, a.x0 + a.x1 as ac, b.x0 + b.x1 as bc
  from box a join det b on a.doc_id = b.doc_id and a.page_index = b.page_index and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),
pr as (select *, round(inter / (aa + ba - inter), 6) as iou from pr0 where round(inter / (aa + ba - inter), 6) >= 0.2)
"""


@query("e01_iou", L + PAIRS + "select doc_id, t, f, iou from pr")
def e01(spark, d):
    return ev.iou_pairs(*boxes(spark, d)).select("doc_id", "t", "f", "iou")


@query("e02_center_area", L + PAIRS + "select doc_id, t, f, round(abs(ac - bc) / 2, 4) as center_distance, round(ba / nullif(aa, 0), 6) as area_ratio from pr")
def e02(spark, d):
    p = ev.iou_pairs(*boxes(spark, d))
    area = lambda a: g.area(*[f"{a}{k}" for k in ("x0", "y0", "x1", "y1")])
    dist = F.sqrt(((F.col("ax0") + F.col("ax1") - F.col("bx0") - F.col("bx1")) / 2) ** 2 + ((F.col("ay0") + F.col("ay1") - F.col("by0") - F.col("by1")) / 2) ** 2)
    return p.select("doc_id", "t", "f", F.round(dist, 4).alias("center_distance"), F.round(area("b") / F.nullif(area("a"), F.lit(0.0)), 6).alias("area_ratio"))


@query("e03_iou_join_counts", L + PAIRS + "select doc_id, count(*) as pairs, round(max(iou), 6) as best from pr group by 1")
def e03(spark, d):
    return ev.iou_pairs(*boxes(spark, d)).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.max("iou").alias("best"))


@query("e04_greedy_match", LR + PAIRS + """, s as (select doc_id, line, t, f, iou, row_number() over (partition by doc_id, line order by iou desc, t, f) as i from pr),
 g as (select doc_id, line, i, t, f, iou, [t] as ut, [f] as uf, true as keep from s where i = 1 union all
  select s.doc_id, s.line, s.i, s.t, s.f, s.iou, case when list_contains(ut, s.t) or list_contains(uf, s.f) then ut else list_append(ut, s.t) end, case when list_contains(ut, s.t) or list_contains(uf, s.f) then uf else list_append(uf, s.f) end,
   not (list_contains(ut, s.t) or list_contains(uf, s.f)) from g join s on s.doc_id = g.doc_id and s.line = g.line and s.i = g.i + 1)
select doc_id, t, f, iou from g where keep""")
def e04(spark, d):
    return lines.matched(t(spark, d, "documents"))


@query("e05_precision_recall", L + """, tp as (select doc_id, count(*) as tp from box semi join det using (doc_id, token_idx) group by 1), n as (select doc_id, count(*) as n from box group by 1), m as (select doc_id, count(*) as m from det group by 1)
select doc_id, round(case when coalesce(m, 0) = 0 then 1 else coalesce(tp, 0) / m end, 6)::double as precision, round(case when n = 0 then 1 else coalesce(tp, 0) / n end, 6)::double as recall,
 round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6)::double as f1 from (select *, (case when coalesce(m, 0) = 0 then 1 else coalesce(tp, 0) / m end)::double as p, (coalesce(tp, 0) / n)::double as r from n left join m using (doc_id) left join tp using (doc_id))""")
def e05(spark, d):
    b, f = boxes(spark, d)
    key = ["doc_id", "token_idx"]
    j = b.select(*key, F.lit(1).alias("b")).join(f.select(*key, F.lit(1).alias("f")), key, "full_outer")
    c = j.groupBy("doc_id").agg(F.count_if(F.col("b").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count("b").alias("n"), F.count("f").alias("m"))
    return c.select("doc_id", *[v.alias(k) for k, v in ev.prf(F.col("tp"), F.col("n"), F.col("m")).items()])


@query("e06_page_sets", L + """, a as (select doc_id, page_index, count(*) as n from box group by 1, 2), b as (select doc_id, page_index, count(*) as m from det where token_idx % 3 = 0 group by 1, 2), j as (select coalesce(a.doc_id, b.doc_id) as doc_id, n, m from a full join b on a.doc_id = b.doc_id and a.page_index = b.page_index)
select doc_id, count(n) as truth_pages, count(m) as found_pages, count(*) filter (where n is not null and m is not null) as both_pages, round(avg(abs(coalesce(n, 0) - coalesce(m, 0))), 6) as count_mae from j group by 1""")
def e06(spark, d):
    b, f = boxes(spark, d)
    a, c = b.groupBy("doc_id", "page_index").agg(F.count("*").alias("n")), f.where("token_idx % 3 = 0").groupBy("doc_id", "page_index").agg(F.count("*").alias("m"))
    return a.join(c, ["doc_id", "page_index"], "full_outer").groupBy("doc_id").agg(F.count("n").alias("truth_pages"), F.count("m").alias("found_pages"), F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("both_pages"), F.round(F.avg(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))), 6).alias("count_mae"))


@query("e07_nearest_rank", "with s as (select l_returnflag as k, list_sort(list(l_extendedprice)) as a from lineitem group by 1) select k, a[round((len(a) - 1) * 0.5)::int + 1] as p50, a[round((len(a) - 1) * 0.9)::int + 1] as p90 from s")
def e07(spark, d):
    return an.nearest_ranks(t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})


@query("e08_pooled_summary", L + """, j as (select doc_id % 5 as ds, count(*) as truth, count(d.token_idx) as tp from box b left join det d using (doc_id, token_idx) group by 1) select coalesce(ds::varchar, 'all') as dataset, sum(truth)::bigint as truth, sum(tp)::bigint as tp, round(sum(tp) / sum(truth), 6) as recall from j group by rollup (ds)""")
def e08(spark, d):
    b, f = boxes(spark, d)
    j = b.join(f.select("doc_id", "token_idx", F.lit(1).alias("hit")), ["doc_id", "token_idx"], "left").withColumn("ds", (F.col("doc_id") % 5).cast("string"))
    return j.rollup("ds").agg(F.count("*").alias("truth"), F.count("hit").alias("tp")).select(F.coalesce("ds", F.lit("all")).alias("dataset"), "truth", "tp", F.round(F.col("tp") / F.col("truth"), 6).alias("recall"))


@query("e09_metric_delta", "with m as (select c_nationkey, count(*)::double as now, sum(case when c_custkey % 2 = 0 then 2 else 0 end)::double as base from customer group by 1) select c_nationkey, round(now - base, 6) as delta, case when abs(base) < 1e-9 then null else round((now - base) / base * 100, 6) end as pct, case when abs(now - base) <= 1e-9 then 'flat' when now > base then 'up' else 'down' end as trend from m")
def e09(spark, d):
    m = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("now"), F.sum(F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(0)).cast("double").alias("base"))
    return m.select("c_nationkey", *[v.alias(k) for k, v in ev.metric_delta(F.col("now"), F.col("base")).items()])


@query("e10_hash_consistency", "with h as (select o_custkey, sha256(o_orderstatus || ':' || o_orderpriority) as h from orders) select o_custkey, count(*) as runs, count(distinct h) as kinds, round(max(c) / count(*), 6) as match_ratio from (select *, count(*) over (partition by o_custkey, h) as c from h) group by 1")
def e10(spark, d):
    return an.hash_consistency(t(spark, d, "orders"), ["o_custkey"], an.signature("o_orderstatus", "o_orderpriority"))


@query("e11_anchor_side", L + """, n as (select doc_id, token_idx, lag(token) over w as truth, lag(token) over (partition by doc_id order by token_idx) as found, lag(x1) over w as tx, lag(x1) over (partition by doc_id order by token_idx) as fx, is_box from tok window w as (partition by doc_id, line order by token_idx))
select doc_id, count(*) as n, count(*) filter (where truth = found) as exact, count(*) filter (where lower(truth) = lower(found)) as soft, count(*) filter (where abs(tx - fx) <= 1) as near, round(avg(abs(tx - fx)), 4) as mean_dx from n where is_box and found is not null group by 1""")
def e11(spark, d):
    w, w2 = Window.partitionBy("doc_id", "line").orderBy("token_idx"), Window.partitionBy("doc_id").orderBy("token_idx")
    n = layout.load(spark, d).select("doc_id", "is_box", F.lag("token").over(w).alias("truth"), F.lag("token").over(w2).alias("found"), F.lag("x1").over(w).alias("tx"), F.lag("x1").over(w2).alias("fx")).where("is_box and found is not null")
    dx = F.abs(F.col("tx") - F.col("fx"))
    return n.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("found")).alias("exact"), F.count_if(F.lower("truth") == F.lower("found")).alias("soft"), F.count_if(dx <= 1).alias("near"), F.round(F.avg(dx), 4).alias("mean_dx"))


@query("e12_row_mapping", "with r as (select conv_id, turn, nullif(regexp_extract('x_row' || (turn * 2), '_row([0-9]+)', 1), '')::int as parsed from conversations), f as (select conv_id, parsed, min(turn) as turn from r group by 1, 2) select c.conv_id, c.turn, coalesce(f.turn, c.turn) as decision from conversations c left join f on f.conv_id = c.conv_id and f.parsed = c.turn")
def e12(spark, d):
    return an.row_mapping(t(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.concat(F.lit("x_row"), (F.col("turn") * 2).cast("string")))


@query("e13_anchor_score", "select l_orderkey, l_linenumber, round(0.10 * (l_quantity / 50) + 0.10 * (1 - l_discount) + 0.45 * (1 - l_tax) + 0.35 * (l_discount * 10), 6) as score from lineitem")
def e13(spark, d):
    score = an.anchor_score(F.col("l_quantity") / 50, 1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_discount") * 10)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("e14_weighted_rollup", "select l_returnflag, round(0.60 * avg(1 - l_tax) + 0.40 * avg(1 - l_discount), 6) as combined from lineitem group by 1")
def e14(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(an.weighted_rollup(1 - F.col("l_tax"), 1 - F.col("l_discount")).alias("combined"))


@query("e15_gap_boxes", L + """, k as (select doc_id, token_idx, x1, [lead(struct_pack(i := token_idx, x := x0), 1) over w, lead(struct_pack(i := token_idx, x := x0), 2) over w, lead(struct_pack(i := token_idx, x := x0), 3) over w, lead(struct_pack(i := token_idx, x := x0), 4) over w, lead(struct_pack(i := token_idx, x := x0), 5) over w] as after_
 from run window w as (partition by doc_id, line order by x0, token_idx)), g as (select doc_id, token_idx as left_idx, x1, unnest(after_) as b from k)
select doc_id, left_idx, b.i as right_idx, round(b.x - x1, 4) as gap from g where round(b.x - x1, 4) between 6 and 160""")
def e15(spark, d):
    return lines.gap_boxes(t(spark, d, "documents"))


@query("e16_seeded_sample", "select o_orderkey from orders order by md5('12345:' || o_orderkey), o_orderkey limit 24")
def e16(spark, d):
    return ev.seeded_sample(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 12345, 24)


@query("e17_word_hits", L + "select doc_id, count(*) as words, round(sum(x1 - x0), 3) as width from tok where regexp_matches(token, '^[A-Za-z]+$') group by 1")
def e17(spark, d):
    return layout.load(spark, d).where(F.rlike("token", F.lit("^[A-Za-z]+$"))).groupBy("doc_id").agg(F.count("*").alias("words"), F.round(F.sum(F.col("x1") - F.col("x0")), 3).alias("width"))


@query("e18_canonical_word", L + "select upper(w) as word, count(*) as n from (select regexp_replace(token, '[^A-Za-z]', '', 'g') as w from tok) where length(w) between 4 and 20 group by 1")
def e18(spark, d):
    w = layout.words(t(spark, d, "documents")).select(F.upper(F.regexp_replace("token", "[^A-Za-z]", "")).alias("word"))
    return w.where(F.length("word").between(4, 20)).groupBy("word").agg(F.count("*").alias("n"))


@query("e19_target_selection", L + """, k as (select *, count(*) over (partition by doc_id, page_index, upper(token)) as same, lag(token) over w as pv, lead(token) over w as nx from tok window w as (partition by doc_id, line order by token_idx)) select doc_id, token_idx, token from k where regexp_matches(token, '^[A-Za-z]{4,20}$') and same = 1 and pv is not null and nx is not null and x1 - x0 >= 6""")
def e19(spark, d):
    return lines.targets(t(spark, d, "documents"))


@query("e20_spaced_sample", LR + """, s as (select doc_id, line, token_idx, target, x0 - 40 as x0, x1 + 40 as x1, row_number() over (partition by doc_id, line order by token_idx) as i from box),
 g as (select doc_id, line, token_idx, target, i, [struct_pack(a := x0, b := x1)] as taken, [target] as texts, true as keep from s where i = 1 union all
  select s.doc_id, s.line, s.token_idx, s.target, s.i, case when ok then list_append(taken, struct_pack(a := s.x0, b := s.x1)) else taken end, case when ok then list_append(texts, s.target) else texts end, ok
  from (select g.taken, g.texts, s, not list_contains(g.texts, s.target) and len([p for p in g.taken if s.x0 < p.b and s.x1 > p.a]) = 0 as ok from g join s on s.doc_id = g.doc_id and s.line = g.line and s.i = g.i + 1))
select doc_id, line, token_idx, target from g where keep""")
def e20(spark, d):
    return lines.spaced(t(spark, d, "documents"), 40.0)  # wide enough to overlap


@query("e21_bounded_dictionary", "select name from (select distinct name from (select c_name as name from customer union all select s_name from supplier)) order by md5('7:' || name), name limit 200")
def e21(spark, d):
    u = t(spark, d, "customer").select(F.col("c_name").alias("name")).union(t(spark, d, "supplier").select("s_name")).distinct()
    return ev.seeded_sample(u, "name", 7, 200)


RANKS = "rk as (select l_returnflag as ds, l_orderkey as label, l_linenumber as run_, case when l_quantity <= 40 then l_quantity::int end as rank, l_extendedprice as err, l_linestatus as fam, l_partkey as cand, l_shipdate as ts from lineitem)"


def ranks(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("ds"), F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("run_"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int")).alias("rank"), F.col("l_extendedprice").alias("err"), F.col("l_linestatus").alias("fam"), F.col("l_partkey").alias("cand"))


@query("e22_target_evaluation", L + PAIRS + "select doc_id, t, min(f) as best_found, round(max(iou), 6) as overlap, arg_max(f, iou) as top from pr group by 1, 2")
def e22(spark, d):
    return ev.iou_pairs(*boxes(spark, d)).groupBy("doc_id", "t").agg(F.min("f").alias("best_found"), F.max("iou").alias("overlap"), F.max_by("f", "iou").alias("top"))


@query("e23_best_rank", f"with {RANKS} select label, min(rank) as best from rk group by 1")
def e23(spark, d):
    return an.best_rank(ranks(spark, d), ["label"])


@query("e24_rank_summary", f"with {RANKS} select ds, count(*) as n, round(avg(case when rank <= 1 then 1.0::double else 0 end), 6) as recall_1, round(avg(case when rank <= 5 then 1.0::double else 0 end), 6) as recall_5, round(avg(case when rank <= 20 then 1.0::double else 0 end), 6) as recall_20, round(avg(coalesce(1 / rank, 0)), 6) as mrr, round(avg(rank), 6) as mean_rank, case when count(*) = count(rank) then max(rank) end as best_feasible_k from rk group by 1")
def e24(spark, d):
    return ev.rank_summary(ranks(spark, d), ["ds"])


@query("e25_weighted_merge", f"with {RANKS}, s as (select ds, fam, count(*) as n, round(avg(coalesce(1 / rank, 0)), 6) as mrr, round(avg(case when rank <= 5 then 1.0::double else 0 end), 6) as recall_5 from rk group by 1, 2) select fam, sum(n)::bigint as n, round(sum(mrr * n) / sum(n), 6) as mrr, round(sum(recall_5 * n) / sum(n), 6) as recall_5 from s group by 1")
def e25(spark, d):
    return ev.weighted_merge(ev.rank_summary(ranks(spark, d), ["ds", "fam"]), ["fam"], "n", ["mrr", "recall_5"])


@query("e26_candidate_stats", L + ", c as (select doc_id, line, count(*) as n, (max(x1) - min(x0)) / min(x1 - x0) >= 2 as multi from box group by 1, 2) select doc_id, count(*) filter (where multi) as multi_rows, count(*) filter (where not multi) as single_rows, round(avg(n) filter (where multi), 6) as multi_mean, max(n) as most from c group by 1")
def e26(spark, d):
    b, _ = boxes(spark, d)
    c = b.groupBy("doc_id", "line").agg(F.count("*").alias("n"), ((F.max("x1") - F.min("x0")) / F.min(F.col("x1") - F.col("x0")) >= 2).alias("multi"))
    return c.groupBy("doc_id").agg(F.count_if("multi").alias("multi_rows"), F.count_if(~F.col("multi")).alias("single_rows"), F.round(F.avg(F.when(F.col("multi"), F.col("n"))), 6).alias("multi_mean"), F.max("n").alias("most"))


@query("e27_quality_counts", f"with {RANKS} select ds, count(*) filter (where rank is null) as missed, count(*) filter (where rank = 1) as first_, count(*) filter (where rank > 20) as late from rk group by 1")
def e27(spark, d):
    return an.quality_counts(ranks(spark, d), ["ds"])


@query("e28_timing_pivot", "select user_id % 10 as run_, round(avg(value) filter (where event_type = 'click'), 6) as click, round(avg(value) filter (where event_type = 'view'), 6) as view_, round(avg(value) filter (where event_type = 'purchase'), 6) as purchase from events group by 1")
def e28(spark, d):
    return an.timing_pivot(t(spark, d, "events").withColumn("run_", F.col("user_id") % 10), ["run_"], "event_type", "value", ["click", "view", "purchase"]).withColumnRenamed("view", "view_")


TOP5 = f"with {RANKS}, k as (select *, row_number() over (partition by label % 500, run_ order by err, cand) as n from rk), a as (select label % 500 as row_, run_, list(cand order by n) as top from k where n <= 5 group by 1, 2)"


def top5(spark, d):
    k = ranks(spark, d).withColumn("row_", F.col("label") % 500)
    k = k.withColumn("n", F.row_number().over(Window.partitionBy("row_", "run_").orderBy("err", "cand"))).where("n <= 5")
    return k.groupBy("row_", "run_").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "cand"))), lambda x: x["cand"]).alias("top"))


@query("e29_stability_jaccard", TOP5 + """ select a.row_, a.run_ as i, b.run_ as j, round(len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top))), 6) as jaccard, a.top[1] = b.top[1] as top1_same from a join a b on a.row_ = b.row_ and a.run_ < b.run_""")
def e29(spark, d):
    a = top5(spark, d)
    b = a.select("row_", F.col("run_").alias("j"), F.col("top").alias("top_b"))
    return a.join(b, "row_").where("run_ < j").select("row_", F.col("run_").alias("i"), "j", F.round(ev.jaccard(F.col("top"), F.col("top_b")), 6).alias("jaccard"), (F.get("top", F.lit(0)) == F.get("top_b", F.lit(0))).alias("top1_same"))


@query("e30_rank_stddev", f"with {RANKS} select label, round(stddev_pop(coalesce(rank, 10000)), 4) as sd from rk group by 1")
def e30(spark, d):
    return ranks(spark, d).groupBy("label").agg(F.round(F.stddev_pop(F.coalesce("rank", F.lit(ev.MISSING_RANK))), 4).alias("sd"))


@query("e31_determinism_gate", f"with {RANKS}, a as (select label, min(cand) as c from rk where run_ % 2 = 0 group by 1), b as (select label, min(cand) as c from rk where run_ % 2 = 1 group by 1) select case when a.label is null then 'missing_left' when b.label is null then 'missing_right' when a.c <> b.c then 'changed' else 'same' end as class, count(*) as n from a full join b on a.label = b.label group by 1")
def e31(spark, d):
    r = ranks(spark, d)
    a, b = (r.where(F.col("run_") % 2 == k).groupBy("label").agg(F.min("cand").alias("c")) for k in (0, 1))
    return an.determinism_gate(a, b, ["label"], "c")


@query("e32_seed_gate", f"with {RANKS}, s as (select run_, avg(case when rank <= 20 then 1.0::double else 0 end) as r20, avg(coalesce(1 / rank, 0)) as mrr from rk group by 1), b as (select max(r20) filter (where run_ = 1) as r0, max(mrr) filter (where run_ = 1) as m0 from s) select run_, r20 >= r0 - 0.03 and mrr >= m0 - 0.002 as pass, mrr > m0 * 1.01 as improved from s, b")
def e32(spark, d):
    return an.seed_gate(ranks(spark, d), "run_", 1)


@query("e33_completeness_gate", f"with {RANKS} select ds, count(distinct run_) as runs, count(distinct label) as labels, count(distinct run_) >= 7 and count(*) = count(err) as complete from rk group by 1")
def e33(spark, d):
    return an.completeness_gate(ranks(spark, d), ["ds"], "run_", "label", "err", 7)


@query("e34_row_selectors", L + ", k as (select *, row_number() over (partition by doc_id order by token_idx desc) as from_end from box) select doc_id, token_idx, page_index = 0 and y0 >= 300 and y1 <= 700 as in_range, from_end::int as from_end from k where (page_index = 0 and y0 >= 300 and y1 <= 700) or from_end <= 2")
def e34(spark, d):
    b, _ = boxes(spark, d)
    return an.row_selectors(b, ["doc_id"], "token_idx", F.expr("page_index = 0 and y0 >= 300 and y1 <= 700"), 2).select("doc_id", "token_idx", "in_range", "from_end")


@query("e35_pool_quality", f"with {RANKS}, b as (select label, min(err) as e0, arg_min(fam, (err, cand)) as f0 from rk where run_ = 1 group by 1) select label, count(*) filter (where err < e0) as better, count(*) filter (where err < e0 and fam = f0) as same_family_better from rk join b using (label) group by 1")
def e35(spark, d):
    return an.pool_quality(ranks(spark, d), ["label"], F.col("run_") == 1, "err", "fam", ["cand"])


@query("e36_family_composition", f"with {RANKS} select ds, fam, count(*) as n from rk group by 1, 2")
def e36(spark, d):
    return ev.histogram(ranks(spark, d), ["ds", "fam"])


@query("e38_template_provenance", f"with {RANKS}, k as (select *, row_number() over (partition by label order by err, cand) as n from rk) select fam, count(*) as candidates, count(*) filter (where n = 1) as top1, count(*) filter (where run_ = 1) as targets, count(*) filter (where run_ = 1 and n > 1) as displaced from k group by 1")
def e38(spark, d):
    return an.template_provenance(ranks(spark, d), ["label"], "fam", F.col("run_") == 1, "err", ["cand"])


@query("e39_component_attribution", "select l_orderkey, l_linenumber, case when abs(l_tax) >= abs(l_discount) and abs(l_tax) >= l_quantity / 500 then 'word' when abs(l_discount) >= l_quantity / 500 then 'char' else 'glyph' end as component from lineitem")
def e39(spark, d):
    part = an.dominant_component({"glyph": F.col("l_quantity") / 500, "char": F.abs("l_discount"), "word": F.abs("l_tax")})
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", part.alias("component"))


@query("e40_best_possible_rank", f"with {RANKS}, k as (select *, row_number() over (partition by label order by err, cand) as all_, case when fam = 'O' then row_number() over (partition by label, fam order by err, cand) end as fam_rank from rk) select label, min(all_) filter (where run_ = 1) as rank_all, min(fam_rank) filter (where run_ = 1) as rank_fam from k group by 1")
def e40(spark, d):
    return an.best_possible_rank(ranks(spark, d), ["label"], F.col("run_") == 1, F.col("fam") == "O", "err", ["cand"])


@query("e41_pairwise_reason", f"with {RANKS}, k as (select *, row_number() over (partition by label order by err, cand) as n from rk), p as (select a.label, a.err as ea, b.err as eb, a.fam as fa, b.fam as fb from k a join k b on a.label = b.label and a.n = 1 and b.n = 2) select label, case when abs(ea - eb) < 1 then 'tie' when fa <> fb then 'family' when ea * 2 < eb then 'error_large' else 'error' end as reason from p")
def e41(spark, d):
    return an.pairwise_reason(ranks(spark, d), ["label"], "err", "fam", ["cand"], 1.0)


@query("e42_tie_density", f"with {RANKS}, b as (select label, err / 10000 as e, min(err / 10000) over (partition by label) as b from rk) select label, count(*) filter (where abs(e - b) <= 0.05) as within_005, count(*) filter (where abs(e - b) <= 0.1) as within_010, count(*) filter (where abs(e - b) <= 0.25) as within_025, count(*) filter (where abs(e - b) <= 0.5) as within_050, count(*) filter (where abs(e - b) <= 1) as within_100 from b group by 1")
def e42(spark, d):
    return ev.tie_density(ranks(spark, d).withColumn("e", F.col("err") / 10000), ["label"], "e")


@query("e43_perturbation", f"with {RANKS}, p as (select label, cand, run_, d, row_number() over (partition by label, d order by abs(err / 10000 - 3 - d), cand, run_) as n from rk, (values (-1.0::double), (-0.5), (-0.25), (0.0), (0.25), (0.5), (1.0)) v(d)) select a.label, count(*) filter (where a.cand = z.cand)::bigint as stable, count(*) as n from p a join p z on a.label = z.label and z.d = 0 and z.n = 1 where a.n = 1 group by 1")
def e43(spark, d):
    return an.perturbation(ranks(spark, d), ["label"], F.col("err") / 10000, F.lit(3.0), "cand", ["cand", "run_"])


@query("e45_pool_ceiling", f"with {RANKS} select label, min(rank) filter (where fam = 'O') as base, min(rank) filter (where fam = 'F') as full_ from rk group by 1")
def e45(spark, d):
    return an.pool_ceiling(ranks(spark, d), ["label"], "fam", {"O": "base", "F": "full_"})


@query("e46_cluster_assignment", f"""with recursive {RANKS}, k as (select label as row_id, label // 8 as cluster, row_number() over (partition by label order by err, cand) as rank, fam as text from rk),
 r as (select cluster, row_id, list(text order by rank) as texts, row_number() over (partition by cluster order by row_id) as i from k group by cluster, row_id),
 g as (select cluster, row_id, i, texts[1] as independent, texts[1] as unique_text, [texts[1]] as used from r where i = 1 union all
  select r.cluster, r.row_id, r.i, r.texts[1], list_filter(r.texts, lambda x: not list_contains(g.used, x))[1], list_concat(g.used, list_filter(r.texts, lambda x: not list_contains(g.used, x))[1:1]) from g join r on r.cluster = g.cluster and r.i = g.i + 1)
select cluster, row_id, independent, unique_text from g""")
def e46(spark, d):
    k = ranks(spark, d).select(F.col("label").alias("row_id"), (F.col("label") / 8).cast("long").alias("cluster"), F.row_number().over(Window.partitionBy("label").orderBy("err", "cand")).alias("rank"), F.col("fam").alias("text"))
    return ev.assigned(k)


@query("e47_gap_percentile", "select l_orderkey, l_linenumber, round(cume_dist() over (partition by l_returnflag order by l_extendedprice), 6) as pct from lineitem")
def e47(spark, d):
    return an.percentile_rank(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", "pct")


@query("e48_box_trust", L + "select case when abs(w - units * font_size / 1000.0::double) <= greatest(5, 0.1 * w) then 'trusted' else 'untrusted' end as trust, count(*) as n from (select *, x1 - x0 + token_idx % 9 as w from tok where is_box) group by 1")
def e48(spark, d):
    b = layout.load(spark, d).where("is_box").withColumn("w", F.col("x1") - F.col("x0") + F.col("token_idx") % 9)
    return b.groupBy(an.box_trust(F.col("w"), F.col("units") * F.col("font_size") / F.lit(1000.0)).alias("trust")).agg(F.count("*").alias("n"))


@query("e49_family_entropy", "with n as (select c_nationkey, c_mktsegment as k, count(*) as c from customer group by 1, 2), p as (select *, c / sum(c) over (partition by c_nationkey) as p from n) select c_nationkey, round(sum(-p * log2(p)), 6) as entropy, arg_min(k, (-c, k)) as dominant, round(max(p), 6) as share from p group by 1")
def e49(spark, d):
    return ev.entropy(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("e50_ablation_best", f"with {RANKS}, s as (select run_, avg(coalesce(1 / rank, 0)) as mrr, avg(rank) as mr from rk group by 1) select arg_max(run_, (mrr, run_)) as best_mrr, arg_min(run_, (mr, run_)) as best_mean_rank from s")
def e50(spark, d):
    return an.ablation_best(ranks(spark, d), "run_")


@query("e51_stability_summary", f"with {RANKS} select ds, count(*) as n, count(distinct sha256(cand::varchar || fam)) as kinds from rk group by 1")
def e51(spark, d):
    return an.distinct_signatures(ranks(spark, d), ["ds"], F.sha2(F.concat(F.col("cand").cast("string"), "fam"), 256), "n")


@query("e52_dictionary_filters", "select p_name as name, len(string_split(p_name, ' ')) > 1 as multi_token, contains(p_name, ',') as comma from part where len(string_split(p_name, ' ')) >= 2 group by 1, 2, 3")
def e52(spark, d):
    return an.multi_token(t(spark, d, "part"), "p_name")


@query("e53_hard_negatives", f"with {RANKS} select cand, min(err) as least from rk group by 1 having min(err) <= 20000 order by least, cand limit 200")
def e53(spark, d):
    return an.hard_negatives(ranks(spark, d), "cand", "err", 20000)


VISUAL = EDGES_SQL + """, vis0 as (select *, font_size * 278::double / 1000 as space_pt, box_x1 - box_x0 as box_w, case when mode = 'two_sided' and prev_box_x1 is null and next_box_x0 is null then right_edge - left_edge end as grouped_w,
  case when mode = 'two_sided' then right_edge - left_edge + 2 * (font_size * 278::double / 1000) end as nearest_w, case when mode <> 'unresolved' then box_x1 - box_x0 - 1 end as dark_w from edge),
vis as (select *, coalesce(grouped_w, nearest_w, dark_w, box_w) as ref_w, case when grouped_w is not null then 'grouped_visual_span' when nearest_w is not null then 'nearest_visual_span' when dark_w is not null then 'redaction_dark_component' else 'redaction_box' end as kind,
  case when grouped_w is not null or nearest_w is not null then 'complete' else 'redaction_only' end as class, target_width + token_idx % 23 - 3 as current_w from vis0)
"""
ALIGNED = "abs({c} - {r}) <= greatest(5.0, abs({r}) * 0.1::double)"


def visual(spark, d):
    """Boxes with the widths that a visual measurement would give, the reference among them, and a current span that is off for some."""
    e = lines.load_edges(spark, d)
    two, gap, box = F.col("mode") == "two_sided", F.col("font_size") * F.lit(278.0) / 1000, F.col("box_x1") - F.col("box_x0")
    inner = F.col("right_edge") - F.col("left_edge")
    v = e.withColumns({"space_pt": gap, "box_w": box, "grouped_w": F.when(two & F.col("prev_box_x1").isNull() & F.col("next_box_x0").isNull(), inner), "nearest_w": F.when(two, inner + 2 * gap), "dark_w": F.when(F.col("mode") != "unresolved", box - 1)})
    v = v.withColumn("ref", an.visual_reference(F.col("grouped_w"), F.col("nearest_w"), F.col("dark_w"), F.col("box_w")))
    return v.withColumns({"kind": F.col("ref.kind"), "class": F.col("ref.class"), "ref_w": F.col("ref.width"), "current_w": F.col("target_width") + F.col("token_idx") % 23 - 3})


@query("e54_visual_reference", L + VISUAL + "select doc_id, token_idx, kind, class, round(ref_w, 4) as width from vis")
def e54(spark, d):
    return visual(spark, d).select("doc_id", "token_idx", "kind", "class", F.round("ref_w", 4).alias("width"))


@query("e55_alignment", L + VISUAL + f"select case when {ALIGNED.format(c='current_w', r='ref_w')} then 'aligned' when current_w - ref_w >= greatest(10.0, abs(ref_w) * 0.15::double) then 'inflated' else 'compressed' end as class, count(*) as n from vis group by 1")
def e55(spark, d):
    return visual(spark, d).groupBy(an.alignment(F.col("current_w"), F.col("ref_w")).alias("class")).agg(F.count("*").alias("n"))


# Each experiment's width, in SQL that both engines read.
WIDTHS = {
    "current_vs_visual_delta": "current_w", "box_vs_visual_delta": "box_w", "boundary_gap_breakdown": "current_w", "boundary_gap_zeroed": "current_w - 2 * space_pt", "boundary_run_only": "current_w - token_idx % 23",
    "join_growth_delta": "token_idx % 23 + ref_w", "nearest_text_pair": "nearest_w", "minimum_gap_valid_pair": "least(nearest_w, target_width)", "per_side_gap_mismatch": "right_edge - left_edge", "visual_aligned_rescore": "ref_w",
    "one_sided_counterfactual": "case mode when 'left_only' then box_x1 - left_edge when 'right_only' then right_edge - box_x0 end", "tie_zone_after_visual_alignment": "ref_w"}
LONG = VISUAL + ", lg as (select doc_id, token_idx, current_w, ref_w, unnest([" + ", ".join(f"{{'e': '{k}', 'w': ({w})::double}}" for k, w in WIDTHS.items()) + "]) as x from vis), ex as (select doc_id, token_idx, x.e as experiment, x.w as width, round(abs(x.w - ref_w), 4) as delta, round(abs(current_w - ref_w) - abs(x.w - ref_w), 4) as improvement from lg)"


@query("e56_counterfactuals", L + LONG + " select experiment, count(width) as n, round(avg(delta), 4) as error, count(*) filter (where improvement > 0.5) as improved from ex group by 1")
def e56(spark, d):
    x = an.experiments(visual(spark, d), ["doc_id", "token_idx"], {k: F.expr(w) for k, w in WIDTHS.items()}, F.col("current_w"), F.col("ref_w"))
    return x.groupBy("experiment").agg(F.count("width").alias("n"), F.round(F.avg("delta"), 4).alias("error"), F.count_if(F.col("improvement") > 0.5).alias("improved"))


GAIN = "abs(current_w - ref_w) - abs({w} - ref_w)"
BY = lambda k, least, share: f"coalesce({GAIN.format(w='(' + WIDTHS[k] + ')')} >= greatest({least}, abs(current_w - ref_w) * {share}::double), false)"


@query("e57_primary_reason", L + VISUAL + f"""select doc_id, token_idx, case when {ALIGNED.format(c='current_w', r='ref_w')} then 'span_aligned' when {BY('nearest_text_pair', 8.0, 0.5)} or {BY('minimum_gap_valid_pair', 8.0, 0.5)} then 'span_inflated_by_far_anchor_pair'
  when {BY('boundary_run_only', 8.0, 0.5)} then 'span_inflated_by_join_growth' when {BY('boundary_gap_zeroed', 5.0, 0.3)} then 'span_inflated_by_boundary_gap' when not {ALIGNED.format(c='box_w', r='ref_w')} then 'redaction_box_unreliable'
  when mode in ('left_only', 'right_only') and class <> 'complete' then 'one_sided_reference_missing' when token_idx % 5 = 0 then 'ranking_tie_after_visual_alignment' else 'unexplained_span_mismatch' end as reason from vis""")
def e57(spark, d):
    c, r = F.col("current_w"), F.col("ref_w")
    gains = {k: an.improvement(F.expr(WIDTHS[k]), c, r) for k in ("nearest_text_pair", "minimum_gap_valid_pair", "boundary_run_only", "boundary_gap_zeroed")}
    reason = an.primary_reason(c, r, F.col("box_w"), F.col("mode"), F.col("class") == "complete", gains, F.col("token_idx") % 5 == 0)
    return visual(spark, d).select("doc_id", "token_idx", reason.alias("reason"))


@query("e59_rank_changes", f"with {RANKS}, a as (select label, min(rank) as x from rk where fam = 'O' group by 1), b as (select label, min(rank) as y from rk where fam = 'F' group by 1) select case when x is null or y is null then 'one_sided' when y < x then 'improved' when y > x then 'worsened' else 'unchanged' end as change, count(*) as n from a full join b on a.label = b.label group by 1")
def e59(spark, d):
    r = ranks(spark, d)
    return an.rank_changes(r.where("fam = 'O'"), r.where("fam = 'F'"), ["label"])


@query("e60_diagnostic_facts", "select user_id, max(value) filter (where event_type = 'click') as click, max(value) filter (where event_type = 'view') as view_ from events group by 1")
def e60(spark, d):
    return an.facts(t(spark, d, "events"), ["user_id"], "event_id", "event_type", "value", {"click": "click", "view_": "view"})


@query("e62_merge_accumulators", f"with {RANKS}, s as (select ds, fam, count(rank) as n, avg(rank) as mae from rk group by 1, 2) select ds, sum(n)::bigint as n, round(sum(mae * n) / sum(n), 6) as mae from s group by 1")
def e62(spark, d):
    s = ranks(spark, d).groupBy("ds", "fam").agg(F.count("rank").alias("n"), F.avg("rank").alias("mae"))
    return ev.weighted_merge(s, ["ds"], "n", ["mae"])


@query("e63_baseline_compare", "with s as (select n_nationkey as stage, n_regionkey::double as score from nation), b as (select s_nationkey as stage, count(*)::double as base from supplier where s_nationkey < 12 group by 1) select stage, round(score - coalesce(base, 0), 6) as delta from s left join b using (stage)")
def e63(spark, d):
    b = t(spark, d, "supplier").where("s_nationkey < 12").groupBy(F.col("s_nationkey").alias("stage")).agg(F.count("*").cast("double").alias("base"))
    return an.baseline_compare(t(spark, d, "nation").select(F.col("n_nationkey").alias("stage"), F.col("n_regionkey").cast("double").alias("score")), b, "stage", "score", "base")


@query("e66_noisy_dictionary", "with tg as (select distinct p_name as w from part where p_partkey % 10 = 0), en as (select w from (select distinct p_name as w from part) anti join tg using (w) order by md5('3:' || w), w limit 1200) select w, 'target' as kind from tg union all select w, 'entry' from en")
def e66(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_name", "w")
    return an.noisy_dictionary(p.where("p_partkey % 10 = 0"), p, "w", lambda df, key, n: ev.seeded_sample(df, key, 3, n))


@query("p01_mode_counters", f"with {RANKS} select cand, count(*) as n from rk group by 1 having count(*) > 1 order by n desc, cand limit 10")
def p01(spark, d):
    return an.most_common(ranks(spark, d), "cand", 10, 2)


@query("p03_seed_clusters", L + "select doc_id, page_index, token_idx, dense_rank() over (partition by doc_id, page_index order by y1) - 1 as cluster from box")
def p03(spark, d):
    return lines.clusters(t(spark, d, "documents"))


@query("p04_token_containment", "select p_partkey, len(list_filter(string_split(p_type, ' '), lambda w: not contains(p_name, lower(w)))) = 0 as contained from part")
def p04(spark, d):
    return t(spark, d, "part").select("p_partkey", an.tokens_contained(F.transform(F.split("p_type", " "), F.lower), F.col("p_name")).alias("contained"))


@query("p05_metric_diff", "with a as (select c_nationkey as k, round(avg(c_acctbal), 4) as v from customer group by 1), b as (select s_nationkey as k, round(avg(s_acctbal), 4) as v from supplier group by 1) select coalesce(a.k, b.k) as k, a.v as left_v, b.v as right_v, coalesce(abs(a.v - b.v) > 1e-6, true) as differs from a full join b on a.k = b.k")
def p05(spark, d):
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("left_v"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("right_v"))
    return an.metric_diff(a, b, "k", "left_v", "right_v")


@query("p06_code_inspector", "select event_id, event_type, value from events where event_type = 'error' or value > 95")
def p06(spark, d):
    return an.by_codes(t(spark, d, "events"), "event_type", ["error"], F.col("value") > 95).select("event_id", "event_type", "value")


@query("p08_sort_dedupe_modes", "select 'exact' as mode, count(distinct p_name) as n from part union all select 'alnum_upper', count(distinct upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))) from part union all select 'normalized', count(distinct upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))) from part union all select 'none', count(*) from part")
def p08(spark, d):
    return an.dedupe_modes(t(spark, d, "part"), "p_name", "p_partkey")


@query("p10_length_constraint", "select p_partkey from part where length(p_name) between 9 and 11 or length(p_name) between 14 and 16")
def p10(spark, d):
    return an.length_constrained(t(spark, d, "part"), "p_name", [10, 15]).select("p_partkey")


HOLDS = {"comma_family": "family = 'comma'", "single_token_family": "family = 'single_token'", "initial_family": "family = 'initial'", "punctuation_heavy_family": "family = 'punctuation_heavy'", **{k: f"template = '{k}'" for k in ("last_comma_first", "first_only", "last_only", "role_alias_pair", "role_alias_comma_pair")},
    "case_transformed": "v.c <> 'raw'", "orthographic_token_shape": "false", "alias_derived": "false", "noncanonical": "template <> 'canonical'", "gen_single_from_multi_raw": "family = 'single_token' and n_words >= 2", "raw_single_entry": "n_words = 1"}
PLANS = ["{'policy': 'none', 'way': 'penalty', 'on_': false, 'extra': 0.0::double}"] + [f"{{'policy': '{way}:{k}{(':' + str(p)) if way == 'penalty' else ''}', 'way': '{way}', 'on_': {c}, 'extra': {p}::double}}" for k, c in HOLDS.items() for way, ps in (("drop", [0.0]), ("keep", [0.0]), ("penalty", (0.25, 0.5, 1.0, 2.75))) for p in ps]


@query("p11_policy_matrix", VARIANTS + f""", cand as (select *, abs(length(v.t) - length(entry) * 0.8::double) as err, v.c = 'uppercase' and ti = (select min(ti) from v1 w where w.entry_idx = v1.entry_idx) as tgt from v1),
  pl as (select entry_idx, v.t as text, err, tgt, unnest([{', '.join(PLANS)}]) as p from cand), kept as (select *, err + case when p.on_ then p.extra else 0 end as e2 from pl where case p.way when 'drop' then not p.on_ when 'keep' then p.on_ else true end),
  rk as (select *, row_number() over (partition by entry_idx, p.policy order by e2, text) as n from kept), best as (select entry_idx, p.policy as policy, min(n) as n from rk where tgt group by 1, 2)
select policy, count(*) as found, round(avg(n), 6) as mean_rank, round(avg(1 / n), 6) as mrr from best group by 1""")
def p11(spark, d):
    c = names.variants(normal(spark, d), roles=False).select("entry_idx", "entry", F.get("variants", F.lit(0))["template"].alias("_first"), F.explode_outer("variants").alias("v")).where("v is not null").select("entry_idx", "entry", "_first", "v.*")
    c = c.withColumns({"family": names.family(F.col("text")), "raw_words": F.size(names.tokens(F.col("entry"))), "err": F.abs(F.length("text") - F.length("entry") * F.lit(0.8))})
    tgt = (F.col("case") == "uppercase") & (F.col("template") == F.col("_first"))
    holds = an.conditions(*map(F.col, ("family", "template", "case", "shape", "alias", "raw_words")))
    return an.policy_matrix(c, ["entry_idx"], holds, tgt, "err", ["text"])


FLAGS = ["l_discount > 0.03", "l_tax > 0.03", "l_quantity > 10", "l_quantity < 40", "l_linenumber > 1", "l_linestatus = 'O'", "l_returnflag = 'N'"]


@query("p12_combo_search", "with f as (select " + " + ".join(f"(({c})::int << {i})" for i, c in enumerate(FLAGS)) + " as bits, l_quantity as q from lineitem), h as (select bits, count(*) as n, sum(q) as s from f group by 1) select c::int as combo, coalesce(sum(n) filter (where bits & c = c), 0)::bigint as n, round(sum(s) filter (where bits & c = c) / sum(n) filter (where bits & c = c), 6) as mean_q from h, range(1, 128) r(c) group by 1")
def p12(spark, d):
    return an.combo_search(t(spark, d, "lineitem"), [F.expr(c) for c in FLAGS], "l_quantity")


@query("p13_median_split", "with e as (select c_nationkey, c_acctbal, median(c_acctbal) over (partition by c_nationkey) as m from customer) select c_nationkey, round(avg(c_acctbal) filter (where c_acctbal <= m), 4) as low, round(avg(c_acctbal) filter (where c_acctbal > m), 4) as high from e group by 1")
def p13(spark, d):
    return an.median_split(t(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_acctbal")


@query("p15_series_summary", "select event_type, round(min(value), 6) as least, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(max(value), 6) as most from events group by 1")
def p15(spark, d):
    return an.series_summary(t(spark, d, "events"), ["event_type"], "value")


@query("p16_signature_stability", "select o_custkey, count(distinct sha256(o_orderstatus)) as signatures from orders group by 1")
def p16(spark, d):
    return an.distinct_signatures(t(spark, d, "orders"), ["o_custkey"], F.sha2("o_orderstatus", 256), name="signatures")


@query("p17_grouping_sets", "select l_returnflag as file, l_linestatus as code, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus))")
def p17(spark, d):
    return an.file_and_corpus_counts(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("p20_rank_delta", f"with {RANKS}, a as (select ds, label, min(rank) as x from rk where run_ <= 3 group by 1, 2), b as (select ds, label, min(rank) as y from rk where run_ > 3 group by 1, 2) select ds, label, y - x as delta from a join b using (ds, label)")
def p20(spark, d):
    r = ranks(spark, d)
    return an.rank_delta(r.where("run_ <= 3"), r.where("run_ > 3"), ["ds", "label"])


@query("p21_policy_variants", f"with {RANKS} select fam, round(avg(rank), 6) as mean, min(rank) as least, sum(rank - 20)::bigint as sum_delta from rk group by 1")
def p21(spark, d):
    return an.policy_variants(ranks(spark, d), ["fam"])


@query("p22_trusted_split", "select round(avg(l_quantity) filter (where l_tax <= 0.04), 6) as trusted, round(avg(l_quantity) filter (where l_tax > 0.04), 6) as untrusted from lineitem")
def p22(spark, d):
    return an.trusted_split(t(spark, d, "lineitem"), F.col("l_tax") <= 0.04, "l_quantity")


@query("p24_combined_summary", f"with {RANKS} select ds, bool_and(rank is not null) as all_found, count(*) filter (where rank > 20 or rank is null) as remaining from rk group by 1")
def p24(spark, d):
    return an.combined_summary(ranks(spark, d), ["ds"])


@query("p25_blocked_one_sided", L + "select doc_id, count(*) filter (where nx is not null and nx - x1 <= 20) as adjacent, count(*) filter (where nx is null) as last_, count(*) as n from (select *, lead(x0) over (partition by doc_id, line order by x0, token_idx) as nx from box) group by 1")
def p25(spark, d):
    b, _ = boxes(spark, d)
    k = b.withColumn("nx", F.lead("x0").over(Window.partitionBy("doc_id", "line").orderBy("x0", "token_idx")))
    return k.groupBy("doc_id").agg(F.count_if(F.col("nx").isNotNull() & (F.col("nx") - F.col("x1") <= 20)).alias("adjacent"), F.count_if(F.col("nx").isNull()).alias("last_"), F.count("*").alias("n"))


@query("p26_batch_counters", "select count(*) filter (where strlen(html) > 0) as ok, count(*) filter (where html is null or strlen(html) = 0) as failed, sum(strlen(html))::bigint as bytes, min(strlen(html)) as least, max(strlen(html)) as most from pages")
def p26(spark, d):
    return an.batch_counters(t(spark, d, "pages"), F.octet_length("html"))
