"""Queries on dictionary expansion, over the part and customer names of the driver's tables."""

import re

from pyspark.sql import functions as F

from ..operators import measure, names
from ..operators import typography as ty
from ..sources import fonts, layout

QUERIES, ORACLE_SQL = {}, {}
P = "(select p_partkey as entry_idx, case p_partkey % 6 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '|') when 2 then 'Dr. ' || p_name || ' Jr' when 3 then replace(p_name, ' ', ' van ') when 4 then replace(p_name, ' ', ', ') else p_name || ' é-x''y' end as entry from part)"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def source(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    sub = lambda by: F.replace(n, F.lit(" "), F.lit(by))
    e = F.when(k == 0, F.upper(n)).when(k == 1, sub("|")).when(k == 2, F.concat(F.lit("Dr. "), n, F.lit(" Jr"))).when(k == 3, sub(" van ")).when(k == 4, sub(", ")).otherwise(F.concat(n, F.lit(" é-x'y")))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("entry_idx"), e.alias("entry"))


def entries(spark, d):
    """Dealt out: an entry makes many variants at some cost each, and few bytes hold many entries, so that a file's block of them would be one task."""
    return measure.spread(source(spark, d), "entry_idx")


NORM = f"(select entry_idx, trim(regexp_replace(replace(entry, '|', ' '), '\\s+', ' ', 'g')) as entry from {P})"


def normal(spark, d):
    return entries(spark, d).withColumn("entry", names.normalise_entry(F.col("entry")))


@query("x01_normalise", f"select * from {NORM}")
def x01(spark, d):
    return normal(spark, d)


@query("s05_dictionary_source", layout.SQL + "select distinct trim(regexp_replace(replace(token, '|', ' '), '\\s+', ' ', 'g')) as entry from tok where token <> ''")
def s05(spark, d):
    return layout.load(spark, d).where("token <> ''").select(names.normalise_entry(F.col("token")).alias("entry")).distinct()


EDGE = names.EDGE.replace("'", "''")


def sql_lead(arr, words):
    """How many elements at the start of a list are among the words."""
    at = f"list_position(list_transform({arr}, lambda x: not list_contains({words}, lower(regexp_replace(x, '{EDGE}', '', 'g')))), true)"
    return f"case when coalesce({at}, 0) = 0 then len({arr}) else {at} - 1 end"


def sql_words(x):
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


SPLIT = f"""with k as (select entry_idx, entry, {sql_words('entry')} as t, case when contains(entry, ',') then {sql_words("trim(split_part(entry, ',', 1))")} else [] end as l, case when contains(entry, ',') then {sql_words("trim(substr(entry, strpos(entry, ',') + 1))")} else [] end as r from {NORM}),
b as (select *, len(l) > 0 and len(r) > 0 as comma, case when len(l) > 0 and len(r) > 0 then r else t end as base from k),
b1 as (select *, {sql_lead('base', names.PREFIXES)} as pe from b), b2 as (select *, base[pe + 1:] as rest from b1), b3 as (select *, list_reverse(rest) as tser from b2),
b4 as (select *, {sql_lead('tser', names.SUFFIXES)} as sf from b3), b5 as (select *, case when len(rest) - sf = 0 then base else rest[1:len(rest) - sf] end as c from b4), b6 as (select *, list_reverse(c)[2:] as cr, len(c) as n from b5),
b7 as (select *, {sql_lead('cr', names.PARTICLES)} + 1 as ss from b6),
np as (select entry_idx, entry, t, base[1:pe] as prefix_t, rest[len(rest) - sf + 1:] as suffix_t, case when comma or n <= 1 then c when ss >= n then c[1:1] else c[1:n - ss] end as given_t,
  case when comma then l when n <= 1 or ss >= n then c else c[n - ss + 1:] end as surname_t, comma, c from b7),
parts as (select entry_idx, entry, t, given_t, surname_t, {', '.join(f"array_to_string({k}_t, ' ') as {k}" for k in ('given', 'surname', 'prefix', 'suffix'))}, {sql_words("array_to_string(case when comma then given_t || surname_t else c end, ' ')")} as core_t,
  contains(entry, ',') or len(list_filter(t, lambda x: list_contains({names.PREFIXES + names.SUFFIXES}, lower(regexp_replace(x, '{EDGE}', '', 'g'))))) > 0
  or len(list_filter(t[1:len(t) - 1], lambda x: list_contains({names.PARTICLES}, lower(regexp_replace(x, '{EDGE}', '', 'g'))))) > 0 as special from np)
"""


@query("x02_name_parts", SPLIT + "select entry_idx, given, surname, prefix, suffix from parts")
def x02(spark, d):
    return names.split_name(normal(spark, d)).drop("entry")


@query("x03_special_structure", SPLIT + "select entry_idx, special, len(t) <= 1 or (not special and len(t) <= 2) as preserve from parts")
def x03(spark, d):
    return normal(spark, d).select("entry_idx", names.has_special_structure(F.col("entry")).alias("special"), names.preserve_shape(F.col("entry")).alias("preserve"))


FOLD = f"translate(%s, '{names.ACCENTED}', '{names.PLAIN}')"


def sql_template(i, name, pattern, holds):
    bits = [x for x in re.split(r"(\{\w+\})", pattern) if x]
    ok = [holds, *(f"{x[1:-1]} <> ''" for x in bits if x[0] == "{"), *(["not contains(entry, ',')"] if name.startswith("last_comma_first") else []), *(["core_first <> core_last"] if name.endswith("from_core") else [])]
    text = " || ".join(x[1:-1] if x[0] == "{" else f"'{x}'" for x in bits)
    return f"case when {' and '.join(ok)} then {{'i': {i}, 'id': '{name}', 'text': {text}}} end"


MADE = [sql_template(i, *x, holds) for i, (x, holds) in enumerate([*((x, "special and len(t) > 0") for x in names.SPECIAL), *((x, "not special and len(t) >= 2") for x in names.SIMPLE)], 1)]
TEMPLATES = (
    SPLIT
    + f""", pp as (select *, array_to_string(core_t, ' ') as core, coalesce(core_t[1], '') as core_first, coalesce(core_t[-1], '') as core_last, coalesce(t[1], '') as first, coalesce(t[-1], '') as last, coalesce(given_t[1], '') as given_first,
  coalesce(surname_t[-1], '') as surname_last, array_to_string(list_transform(given_t[2:], lambda x: x[1] || '.'), ' ') as middle from parts),
tp0 as (select entry_idx, entry, special, len(t) as n_words, unnest([{{'i': 0, 'id': 'canonical', 'text': entry}}, {', '.join(MADE)}]) as t from pp),
tp1 as (select * from tp0 where t is not null and t.text <> '' and (n_words <= 1 or (not special and n_words <= 2) or t.text <> entry) and not (contains(entry, ',') and contains(t.text, ','))),
tp as (select entry_idx, entry, n_words, t from (select *, row_number() over (partition by entry_idx, t.text order by t.i) as k_ from tp1) where k_ = 1)
"""
)


@query("x04_templates", TEMPLATES + "select entry_idx, t.id as template, t.text as text from tp")
def x04(spark, d):
    return names.templates(normal(spark, d)).select("entry_idx", F.explode_outer("templates").alias("t")).where("t is not null").select("entry_idx", F.col("t.id").alias("template"), "t.text")


ALIAS = "(select lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) as key, min(p_brand) as alias from part group by 1 union all select lower(split_part(p_name, ' ', 1)), min('al-' || p_brand) from part group by 1)"


@query("x05_role_aliases", SPLIT + f", k2 as (select entry_idx, surname, lower(regexp_replace({FOLD % 'given'}, '[^A-Za-z0-9]', '', 'g')) as key from parts), j as (select *, row_number() over (partition by entry_idx order by alias) as n from k2 join {ALIAS} al using (key)) select entry_idx, case when surname is null then alias else alias || ' ' || surname end as text from j where n <= 8")
def x05(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    al = part.groupBy(F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]", "")).alias("key")).agg(F.min("p_brand").alias("alias")).unionByName(part.groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).agg(F.min(F.concat(F.lit("al-"), "p_brand")).alias("alias")))
    return names.role_aliases(names.split_name(normal(spark, d)).select("entry_idx", "given", "surname"), al)


@query("x05_role_templates")
def x05b(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    al = part.groupBy(F.lit("given").alias("role"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).agg(F.min(F.concat(F.lit("al-"), "p_brand")).alias("alias")).withColumn("place", F.lit(0))
    e = names.together(source(spark, d).withColumn("entry", names.normalise_entry(F.col("entry"))))
    return names.role_templates(e, al).select("ids", F.explode_outer("roles").alias("r")).where("r is not null").select(F.explode("ids").alias("e"), "r").select("e.entry_idx", "r.*")


@query("x06_latin_fold", layout.SQL + f"select token, {FOLD % 'token'} as folded, count(*) as n from tok where {FOLD % 'token'} <> token group by 1, 2")
def x06(spark, d):
    return layout.load(spark, d).withColumn("folded", names.fold_latin(F.col("token"))).where("folded <> token").groupBy("token", "folded").agg(F.count("*").alias("n"))


@query("x07_orthographic", f"select entry_idx, list_distinct([entry, replace(entry, '-', ' '), replace(entry, ' ', '-'), replace(entry, '-', '')]).len() as n_shapes from {NORM}")
def x07(spark, d):
    return normal(spark, d).select("entry_idx", F.size(names.shapes(F.col("entry"))).cast("long").alias("n_shapes"))


TITLE = """array_to_string(list_transform(range(1, length(%s) + 1), lambda i: case when i = 1 or (%s)[i - 1] in (' ', '-', '''') then upper((%s)[i]) else lower((%s)[i]) end), '')"""
title = lambda x: TITLE % (x, x, x, x)


@query("x08_case_variants", f"with v as (select entry_idx, entry, unnest([{{'i': 0, 'c': 'raw', 't': entry}}, {{'i': 1, 'c': 'uppercase', 't': upper(entry)}}, {{'i': 2, 'c': 'lowercase', 't': lower(entry)}}, {{'i': 3, 'c': 'titlecase', 't': {title('entry')}}}]) as v from {NORM}) select entry_idx, arg_min(v.c, v.i) as \"case\", v.t as text from v group by entry_idx, v.t")
def x08(spark, d):
    return normal(spark, d).select("entry_idx", F.explode(names.case_variants(F.col("entry"))).alias("v")).select("entry_idx", "v.case", "v.text")


@query("x09_title_case", f"select entry_idx, {title('entry')} as title from {NORM}")
def x09(spark, d):
    return normal(spark, d).select("entry_idx", names.title_case(F.col("entry")).alias("title"))


LETTERS = "length(regexp_replace(%s, '[^A-Za-z]', '', 'g'))"
FAMILY = f"""case when trim({{x}}) = '' then 'empty' when contains({{x}}, ',') then 'comma' when length(regexp_replace(trim({{x}}), '[A-Za-z0-9\\s]', '', 'g')) > {LETTERS % 'trim({x})'} then 'punctuation_heavy'
 when len({sql_words('trim({x})')}) = 1 then case when {LETTERS % 'trim({x})'} <= 2 or ends_with(trim({{x}}), '.') then 'initial' else 'single_token' end
 when len(list_filter(string_split(trim({{x}}), ' '), lambda w: w <> '' and ({LETTERS % 'w'} <= 1 or ends_with(w, '.')))) > 0 then 'initial' else 'plain_multi_token' end"""


@query("x10_family", TEMPLATES + f", f as (select {FAMILY.format(x='t.text')} as family from tp) select family, count(*) as n from f group by 1")
def x10(spark, d):
    return x04(spark, d).groupBy(names.family(F.col("text")).alias("family")).agg(F.count("*").alias("n"))


VARIANTS = (
    TEMPLATES
    + f""", v0 as (select entry_idx, entry, n_words, t.i as ti, t.id as template, unnest([{{'i': 0, 'c': 'raw', 't': t.text}}, {{'i': 1, 'c': 'uppercase', 't': upper(t.text)}}, {{'i': 2, 'c': 'lowercase', 't': lower(t.text)}}, {{'i': 3, 'c': 'titlecase', 't': {title('t.text')}}}]) as v from tp),
v1 as (select *, {FAMILY.format(x='v.t')} as family from (select *, row_number() over (partition by entry_idx, v.t order by ti, v.i) as same from v0) where same = 1),
v2 as (select *, family = 'comma' or (family = 'single_token' and n_words >= 2) as skip from v1), v3 as (select *, row_number() over (partition by entry_idx order by ti, v.i) as n0 from v2 where not skip),
v4 as (select *, row_number() over (partition by v.t order by entry_idx, ti, v.i) as k_ from v3 where n0 <= 24), var as (select entry_idx, v.t as text, template, family, v.c as "case" from v4 where k_ = 1)
"""
)


@query("x12_expand_dedupe", VARIANTS + "select * from var")
def x12(spark, d):
    return names.expand(source(spark, d), roles=False).drop("variant_idx", "alias", "shape")


@query("x11_policy_counts", VARIANTS + "select family, count(*) as generated, count(*) filter (where skip) as skipped from v2 group by 1")
def x11(spark, d):
    v = names.variants(normal(spark, d), roles=False).select("entry", F.explode_outer("variants").alias("v")).where("v is not null").withColumn("family", names.family(F.col("v.text")))
    return v.groupBy("family").agg(F.count("*").alias("generated"), F.count_if(names.skipped(F.col("entry"), F.col("family"))).alias("skipped"))


@query("x13_merge_sources", "select p_type as kind, array_to_string(list_sort(list_distinct(list(p_brand))), ',') as sources from part group by 1")
def x13(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("kind")).agg(names.merge_sources(F.collect_set("p_brand")).alias("sources"))


@query("x14_alias_key", layout.SQL + f"select lower(regexp_replace({FOLD % 'token'}, '[^A-Za-z0-9]', '', 'g')) as key, count(*) as n from tok group by 1")
def x14(spark, d):
    return layout.load(spark, d).groupBy(names.alias_key(F.col("token")).alias("key")).agg(F.count("*").alias("n"))


@query("x15_lookup_key", layout.SQL + "select lower(regexp_replace(token, '^[^A-Za-z0-9''-]+|[^A-Za-z0-9''-]+$', '', 'g')) as key, count(*) as n from tok where regexp_matches(token, '^[ -~]*$') group by 1")
def x15(spark, d):
    return layout.load(spark, d).where(F.rlike("token", F.lit("^[ -~]*$"))).groupBy(names.lookup_key(F.col("token")).alias("key")).agg(F.count("*").alias("n"))


@query("t14_subset_prefix", "select p_partkey, regexp_replace(f, '^[A-Z]{6}\\+([^+]+)$', '\\1') as base from (select p_partkey, case when p_partkey % 2 = 0 then 'ABCDEF+' || p_brand else p_brand end as f from part)")
def t14(spark, d):
    f = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ABCDEF+"), "p_brand")).otherwise(F.col("p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", fonts.subset_base(f).alias("base"))


@query("t15_family_variant", "select p_partkey, case when len(string_split(f, '-')) = 2 then split_part(f, '-', 1) else f end as family, case when len(string_split(f, '-')) = 2 then split_part(f, '-', 2) end as variant from (select p_partkey, replace(p_type, ' ', '-') as f from part)")
def t15(spark, d):
    family, variant = fonts.family_variant(F.replace("p_type", F.lit(" "), F.lit("-")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", family.alias("family"), variant.alias("variant"))


@query("t16_input_kind", "select kind, count(*) as n from (select case when lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)) = 'pdf' then 'pdf' when lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)) in ('html', 'htm') then 'html' when lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)) in ('png', 'jpg', 'jpeg') then 'image' else 'unknown' end as kind from pages) group by kind")
def t16(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").groupBy(fonts.input_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("t17_quote_folding", "select doc_id, length(translate(text, '‰‹«›»', '<<<>>')) - length(replace(translate(text, '‰‹«›»', '<<<>>'), '<', '')) as opened from documents")
def t17(spark, d):
    t = fonts.fold_quotes(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit("<"), F.lit("")))).cast("long").alias("opened"))


@query("f01_font_counts", "select p_brand as family, p_type as variant, count(*) as n from part group by 1, 2")
def f01(spark, d):
    return ty.font_counts(spark.read.parquet(f"{d}/part.parquet"), "p_brand", "p_type")


@query("f02_distinct_fonts", "select distinct p_brand as family, p_type as variant from part")
def f02(spark, d):
    return ty.distinct_fonts(spark.read.parquet(f"{d}/part.parquet"), "p_brand", "p_type")


@query("f04_inventory_rollup", "select coalesce(l_returnflag, 'all') as file, coalesce(l_linestatus, 'all') as source, count(*) as n, count(*) filter (where l_quantity > 25) as with_widths from lineitem group by rollup (l_returnflag, l_linestatus)")
def f04(spark, d):
    return ty.inventory_rollup(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_linestatus", {"with_widths": F.col("l_quantity") > 25})


@query("f05_all_have_source", "select count(*) filter (where ok) as complete, count(*) as files from (select l_orderkey, bool_and(l_tax > 0) as ok from lineitem group by 1)")
def f05(spark, d):
    return ty.complete_files(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", F.col("l_tax") > 0)
