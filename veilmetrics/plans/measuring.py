"""Queries on text widths, scoring, penalties, ranking, deduplication, diagnostics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import widths
from ..operators import context, fitting, measure, names
from ..operators import typography as ty
from ..sources import layout, lines
from .dictionary import VARIANTS, source
from .flagship import DICT_SQL, EDGES_SQL

L = layout.SQL
QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


UNITS = f"list_sum(list_transform(string_split({{x}}, ''), lambda c: case when c = '' then 0 when ascii(c) between 32 and 126 then ({widths.HELVETICA})[ascii(c) - 31] end))"
MISSING = "len(list_filter(string_split({x}, ''), lambda c: c <> '' and not ascii(c) between 32 and 126))"


@query("m01_width_by_code", L + f", s as (select distinct token from tok) select token, case when {MISSING.format(x='token')} > 0 then null else {UNITS.format(x='token')}::bigint end as units, case when {MISSING.format(x='token')} > 0 then 'char_unmapped' else 'ok' end as reason from s where token <> ''")
def m01(spark, d):
    s = layout.words(spark.read.parquet(f"{d}/documents.parquet")).select("token").where("token <> ''").distinct().withColumn("units", widths.strict_units(F.col("token")))
    return s.withColumn("reason", F.when(F.col("units").isNull(), "char_unmapped").otherwise("ok"))


@query("m02_projection", L + "select doc_id, token_idx, round(units * font_size / 1000::double * greatest(95::double / 100, 0.01) + 0.2::double * (length(token) - 1) + 0.5::double * (length(token) - length(replace(token, ' ', ''))), 6) as width_pt from tok where is_box")
def m02(spark, d):
    n = F.length("token")
    w = widths.project(F.col("units"), F.col("font_size"), n, n - F.length(F.replace("token", F.lit(" "), F.lit(""))), 95.0, 0.2, 0.5)
    return layout.load(spark, d).where("is_box").select("doc_id", "token_idx", F.round(w, 6).alias("width_pt"))


@query("m03_row_variant_product", L + EDGES_SQL + VARIANTS.replace("with k as", ", k as", 1) + "select mode, count(*) as pairs from (select * from edge where mode <> 'unresolved') e, (select distinct template from var) v group by 1")
def m03(spark, d):
    v = names.expand(source(spark, d), roles=False).select("template").distinct()
    return lines.load_edges(spark, d).where("mode <> 'unresolved'").crossJoin(F.broadcast(v)).groupBy("mode").agg(F.count("*").alias("pairs"))


TOLERANCE_SQL = """, nx as (select doc_id, line, x0 - lag(x1) over (partition by doc_id, line order by token_idx) - font_size * 0.278::double as res from run),
 ns as (select doc_id, line, list_sort(list(round(res, 4) + 0.0::double)) as a from nx where res is not null group by 1, 2), nm as (select doc_id, line, a, a[floor(len(a) * 0.5)::int + 1] as med from ns),
 tol as materialized (select doc_id, line, least(8, greatest(3.5, list_sort([round(abs(x - med), 4) for x in a])[floor(len(a) * 0.75)::int + 1]))::double as tolerance from nm)"""
FIT_SQL = (
    L
    + EDGES_SQL
    + TOLERANCE_SQL
    + VARIANTS.replace("with k as", ", k as", 1)
    + rf""", fv as materialized (select text, template, upper(trim(regexp_replace(text, '\s+', ' ', 'g'))) as norm, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as alpha, {UNITS.format(x='text')}::bigint as units from var where {MISSING.format(x='text')} = 0),
 fv2 as materialized (select *, len([x for x in string_split(norm, ' ') if x <> '']) as toks from fv where norm <> ''),
 fr as materialized (select e.doc_id, e.token_idx, e.mode, e.font_size, e.left_edge, e.right_edge, e.box_x0, e.box_x1, e.prev_box_x1, e.next_box_x0, e.target_width, coalesce(tol.tolerance, 3.5) as tolerance from edge e left join tol using (doc_id, line) where e.mode <> 'unresolved'),
 fe as (select fr.*, v.text, v.template, v.norm, v.alpha, v.toks, v.units * font_size / 1000::double as w, case when mode = 'right_only' then right_edge - w else left_edge end as pl, case when mode = 'right_only' then right_edge else left_edge + w end as pr,
  round(case mode when 'two_sided' then abs(left_edge + w - right_edge) when 'left_only' then abs(left_edge + w - box_x1) else abs(right_edge - w - box_x0) end, 4) as error_pt from fr, fv2 v),
 fa as (select *, case when template = 'canonical' then error_pt else round(error_pt + 2.75, 4) end as adjusted from fe where not coalesce(prev_box_x1 - pl > tolerance, false) and not coalesce(pr - next_box_x0 > tolerance, false)),
 fd as (select doc_id, token_idx, norm, min(struct_pack(adjusted := adjusted, la := -alpha, lt := -toks, text := text, template := template, error_pt := error_pt, tolerance := tolerance)) as c from fa group by 1, 2, 3),
 fit as materialized (select * from (select doc_id, token_idx, norm, c.*, row_number() over (partition by doc_id, token_idx order by c.adjusted, c.la, c.lt, norm) as rank from fd) where rank <= 20)
"""
)


def fit_rows(spark, d):
    """Boxes with edges and the tolerance of their line, and the measured variants of the dictionary."""
    return lines.load_edges(spark, d), fitting.measured(names.expand(source(spark, d), roles=False))


@query("m09_fitted_variants", FIT_SQL + "select doc_id, token_idx, rank::int as rank, text, template, error_pt, adjusted, round(adjusted / greatest(tolerance, 1), 8) as normalised from fit")
def m09_fit(spark, d):
    rows, variants = fit_rows(spark, d)
    return fitting.fitted(rows, variants).drop("norm")


@query("m12_fitted_boxes", FIT_SQL + "select b.doc_id, b.token_idx, coalesce(r.mode, 'unresolved') as mode, round(coalesce(r.target_width, b.x1 - b.x0), 4) as target_width, f.rank::int as rank, f.text, f.adjusted from box b left join fr r on b.doc_id = r.doc_id and b.token_idx = r.token_idx left join fit f on b.doc_id = f.doc_id and b.token_idx = f.token_idx")
def m12_fit(spark, d):
    rows, variants = fit_rows(spark, d)
    d = fitting.fitted(rows, variants, every=True).withColumn("target_width", F.round("target_width", 4))  # a row for each box, with its target width
    return d.select("doc_id", "token_idx", "mode", "target_width", "rank", "text", "adjusted")


@query("m04_support_cache", L + DICT_SQL + ", f as (select distinct font_size from tok) select font_size, count(*) as texts, round(sum(units * font_size / 1000::double), 3) as total_pt from dict, f group by 1")
def m04(spark, d):
    t = layout.load(spark, d)
    by_units = measure.dictionary(t).groupBy("units").agg(F.count("*").alias("n"))
    f = t.select("font_size").distinct()
    return by_units.crossJoin(F.broadcast(f)).groupBy("font_size").agg(F.sum("n").alias("texts"), F.round(F.sum(F.col("n") * F.col("units") * F.col("font_size") / F.lit(1000.0)), 3).alias("total_pt"))


SELF = EDGES_SQL + """, sc as (select *, units * font_size / 1000::double as w from edge),
se as (select *, round(case mode when 'two_sided' then abs(left_edge + w - right_edge) when 'left_only' then abs(left_edge + w - box_x1) when 'right_only' then abs(right_edge - w - box_x0) end, 4) as err,
  case mode when 'two_sided' then left_edge when 'left_only' then left_edge when 'right_only' then right_edge - w end as pl, case mode when 'two_sided' then left_edge + w when 'left_only' then left_edge + w when 'right_only' then right_edge end as pr from sc)
"""


def own(spark, d):
    """Every box measured against the word that it hides."""
    w = F.col("units") * F.col("font_size") / F.lit(1000.0)
    return lines.load_edges(spark, d).withColumns({"err": F.round(measure.error_pt(w), 4), "pl": measure.predicted_left(w), "pr": measure.predicted_right(w), "bad": measure.overlaps_neighbour(w, F.lit(1.0))})


@query("m05_edge_error", L + SELF + "select doc_id, token_idx, mode, err, round(pl, 4) as pl, round(pr, 4) as pr from se")
def m05(spark, d):
    return own(spark, d).select("doc_id", "token_idx", "mode", "err", F.round("pl", 4).alias("pl"), F.round("pr", 4).alias("pr"))


@query("m06_penalty", L + SELF + "select doc_id, token_idx, round(err + case when token_idx % 2 = 0 then 0 else 2.75::double end, 4) as adjusted, round((err + case when token_idx % 2 = 0 then 0 else 2.75::double end) / greatest(3.5, 1), 4) as normalised from se where mode <> 'unresolved'")
def m06(spark, d):
    adj, norm = measure.penalised(F.col("err"), F.when(F.col("token_idx") % 2 == 0, "canonical").otherwise("comma"), F.lit(3.5))
    return own(spark, d).where("mode <> 'unresolved'").select("doc_id", "token_idx", F.round(adj, 4).alias("adjusted"), F.round(norm, 4).alias("normalised"))


@query("m07_neighbour_overlap", L + SELF + "select mode, count(*) as n, count(*) filter (where coalesce(prev_box_x1 - pl > 1, false) or coalesce(pr - next_box_x0 > 1, false)) as rejected from se group by 1")
def m07(spark, d):
    return own(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.count_if("bad").alias("rejected"))


V = "with v as (select p_partkey as row_, unnest(['A ' || p_name, lower(p_name), upper(p_name), p_name]) as text, unnest([0.1::double, 0.3, 0.2, 0.2]) + (p_size % 3) / 10::double as err, unnest(['canonical', 'comma', 'initial', 'canonical']) as fam from part), s as (select *, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm, round(err + case when fam = 'canonical' then 0 else 2.75::double end, 4) as adj, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as alpha, len(string_split(text, ' ')) as toks from v)"


def variants(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    n = F.col("p_name")
    arr = F.array(*[F.struct(t.alias("text"), F.lit(e).alias("e"), F.lit(f).alias("fam")) for t, e, f in ((F.concat(F.lit("A "), n), 0.1, "canonical"), (F.lower(n), 0.3, "comma"), (F.upper(n), 0.2, "initial"), (n, 0.2, "canonical"))])
    v = p.select(F.col("p_partkey").alias("row_"), (F.col("p_size") % 3 / F.lit(10.0)).alias("b"), F.explode(arr).alias("v")).select("row_", "v.text", (F.col("v.e") + F.col("b")).alias("err"), "v.fam")
    adj, _ = measure.penalised(F.col("err"), F.col("fam"), F.lit(1.0))
    return v.withColumns({"norm": F.upper(names.normalise_entry(F.col("text"))), "adj": F.round(adj, 4), "alpha": F.length(F.regexp_replace("text", "[^A-Za-z]", "")), "toks": F.size(F.split("text", " "))})


ORDER = "adj, alpha desc, toks desc, norm, text"


def order():
    return [F.col("adj"), F.desc("alpha"), F.desc("toks"), F.col("norm"), F.col("text")]


@query("m08_ranking", V + f" select row_, text, row_number() over (partition by row_ order by {ORDER})::int as rank from s")
def m08(spark, d):
    return variants(spark, d).select("row_", "text", F.row_number().over(Window.partitionBy("row_").orderBy(*order())).alias("rank"))


@query("m09_dedupe", V + f", k as (select *, row_number() over (partition by row_ order by {ORDER}) as r from s), f as (select *, row_number() over (partition by row_, norm order by r) as n from k) select row_, text, row_number() over (partition by row_ order by r)::int as rank from f where n = 1")
def m09(spark, d):
    r = variants(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("row_").orderBy(*order())))
    return measure.dedupe_ranked(r, ["row_"]).select("row_", "text", "rank")


@query("m10_counterfactual_top1", V + " select row_, arg_min(text, (adj, -alpha, -toks, norm, text)) as penalised_top, arg_min(text, (round(err, 4), -alpha, -toks, norm, text)) as raw_top from s group by 1")
def m10(spark, d):
    key = lambda e: F.struct(e.alias("e"), -F.col("alpha"), -F.col("toks"), "norm", "text")
    return variants(spark, d).groupBy("row_").agg(F.min_by("text", key(F.col("adj"))).alias("penalised_top"), F.min_by("text", key(F.round("err", 4))).alias("raw_top"))


@query("m11_tiebreak_diagnostic", V + f", k as (select *, row_number() over (partition by row_ order by {ORDER}) as r, lead(alpha) over (partition by row_ order by {ORDER}) as next_alpha, lead(adj) over (partition by row_ order by {ORDER}) as next_adj from s) select row_, text as winner, alpha - next_alpha as longer_by, adj = next_adj as tied from k where r = 1")
def m11(spark, d):
    w = Window.partitionBy("row_").orderBy(*order())
    k = variants(spark, d).withColumns({"r": F.row_number().over(w), "na": F.lead("alpha").over(w), "ne": F.lead("adj").over(w)})
    return k.where("r = 1").select("row_", F.col("text").alias("winner"), (F.col("alpha") - F.col("na")).cast("long").alias("longer_by"), (F.col("adj") == F.col("ne")).alias("tied"))


@query("m13_anchor_only", L + EDGES_SQL + "select doc_id, line, list(mode order by token_idx)::varchar as modes from edge group by 1, 2")
def m13(spark, d):
    e = lines.load_edges(spark, d).groupBy("doc_id", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("token_idx", "mode"))), lambda x: x["mode"]).alias("m"))
    return e.select("doc_id", "line", F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("modes"))


@query("m14_diagnostics_log", L + SELF + "select page_index, doc_id, token_idx, stage, code from (select page_index, doc_id, token_idx, 'anchor' as stage, mode as code from se union all select page_index, doc_id, token_idx, 'score', case when err is null then 'no_error' when err <= 0.01 then 'exact' else 'off' end from se)")
def m14(spark, d):
    o = own(spark, d)
    a = o.select("page_index", "doc_id", "token_idx", F.lit("anchor").alias("stage"), F.col("mode").alias("code"))
    return a.unionByName(o.select("page_index", "doc_id", "token_idx", F.lit("score").alias("stage"), F.when(F.col("err").isNull(), "no_error").when(F.col("err") <= 0.01, "exact").otherwise("off").alias("code")))


@query("t05_newline_delta", "select event_id, round(case when abs(value - 50) > 0.01 then -(value - 50) else -1.2 * (10 + user_id % 3) end, 4) as delta from events")
def t05(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(ty.newline_delta(F.col("value") - 50, 10 + F.col("user_id") % 3), 4).alias("delta"))


CHARS = f"list_filter(string_split(token, ''), lambda c: c <> '')"


@query("t06_run_width", L + "select doc_id, token_idx, round(greatest(0.001, units * font_size / 1000::double + (length(token) - 1) * 0.3::double * font_size / 1000 + case when length(token) > 3 then -0.5::double else 0 end), 4) as width from tok where token <> ''")
def t06(spark, d):
    n = F.length("token")
    w = ty.run_width(F.col("units") * F.col("font_size") / F.lit(1000.0), n, F.lit(0.3) * F.col("font_size") / 1000, F.lit(0.0), F.lit(0), F.when(n > 3, -0.5).otherwise(0.0))
    return layout.load(spark, d).where("token <> ''").select("doc_id", "token_idx", F.round(w, 4).alias("width"))


@query("t07_normalise_advances", f"with a as (select vec_id, list_transform(embedding, lambda x: round(x::double, 6)) as a from embeddings), s as (select *, len(list_filter(a, lambda x: x < 0)) as neg, list_sum(a) as s from a) select vec_id, neg > 0 as uniform, round(case when neg > 0 then 100.0::double / len(a) else a[1] * 100 / s end, 4) as first_ from s")
def t07(spark, d):
    a = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("a"))
    return a.select("vec_id", F.exists("a", lambda x: x < 0).alias("uniform"), F.round(F.get(ty.normalised_advances(F.col("a"), F.lit(100.0)), F.lit(0)), 4).alias("first_"))


@query("t09_core_font_width", L + f", s as (select token, count(*) as n from tok where token <> '' group by 1) select token, n, case when {MISSING.format(x='token')} = 0 then round({UNITS.format(x='token')} * 12 / 1000::double, 4) else round(greatest(1, 0.6::double * 12 * length(token)), 4) end as width from s")
def t09(spark, d):
    s = layout.words(spark.read.parquet(f"{d}/documents.parquet")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    core = widths.strict_units(F.col("token")) * 12 / F.lit(1000.0)
    return s.select("token", "n", F.round(F.coalesce(core, widths.fallback_width(12.0, F.length("token"))), 4).alias("width"))


@query("t10_fallback_width", "select p_partkey, round(greatest(1.0, 0.6::double * p_size * length(p_name) * greatest(p_retailprice / 1000, 0.01)), 4) as width from part")
def t10(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(widths.fallback_width(F.col("p_size"), F.length("p_name"), F.greatest(F.col("p_retailprice") / 1000, F.lit(0.01))), 4).alias("width"))


@query("t12_width_priority", "select l_orderkey, l_linenumber, coalesce(case when l_discount > 0.05 then 'explicit' end, case when l_tax > 0.03 then 'standard14' end, 'none') as source from lineitem")
def t12(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", ty.width_source(F.col("l_discount") > 0.05, F.col("l_tax") > 0.03).alias("source"))
