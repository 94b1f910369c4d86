"""Dictionary expansion: normalising entries, name parts, templates, role variants, case variants, families.

Alias tables are inputs; none are shipped. A template is a pattern over the parts of a name, and is made if all its parts
are there; the same table gives the queries' SQL.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measure import spread

# Titles before a name.
PREFIXES = "mr mrs ms mx dr prof sir dame lady lord rev fr judge hon capt cmdr col gen adm pres president governor lt sgt".split()
# Words after a name.
SUFFIXES = "jr sr ii iii iv v vi phd md esq esquire jd dds dmd do rn cpa mba qc kc ret retired junior senior".split()
# Particles that belong to the surname.
PARTICLES = "al ap ben bin da dal de del dela della der di dos du el ibn la le st st. ter van vanden vander von zu zum zur".split()
# Accented Latin letters and their base letters, one for one.
ACCENTED = "áàâäãåçćčéèêëíìîïłñńóòôöõśúùûüýÿżźžÁÀÂÄÃÅÇĆČÉÈÊËÍÌÎÏŁÑŃÓÒÔÖÕŚÚÙÛÜÝŸŻŹŽ"
PLAIN = "aaaaaaccceeeeiiiilnnooooosuuuuyyzzzAAAAAACCCEEEEIIIILNNOOOOOSUUUUYYZZZ"
# The most variants of an entry, of a token, of one side of a name, and of pairs of sides.
MAX_VARIANTS, MAX_TOKEN, MAX_SIDE, MAX_PAIRS = 24, 8, 24, 64
# Letters whose upper case in full is more than one letter, and the one letter that stands for it, if there is one.
LONG_UPPER = [chr(i) for i in range(128, 0x10000) if len(chr(i).upper()) > 1]
ONE_UPPER = {c: c.title() for c in LONG_UPPER if len(c.title()) == 1} | {"\u00df": "\u1e9e"}
EDGE = r"^[^\p{L}\p{N}'-]+|[^\p{L}\p{N}'-]+$"

# The templates in order. Names with a title, suffix, particle or comma have the first list, other names of two
# words or more the second; `canonical` comes before both.
SPECIAL = [
    ("core_tokens", "{core}"), ("given_first_surname", "{given_first} {surname}"), ("surname_comma_given_first", "{surname}, {given_first}"),
    ("prefix_given_first_surname", "{prefix} {given_first} {surname}"), ("given_first_surname_suffix", "{given_first} {surname} {suffix}"),
    ("prefix_given_first_surname_suffix", "{prefix} {given_first} {surname} {suffix}"), ("given_surname", "{given} {surname}"),
    ("given_surname_suffix", "{given} {surname} {suffix}"), ("prefix_given_surname", "{prefix} {given} {surname}"),
    ("prefix_given_surname_suffix", "{prefix} {given} {surname} {suffix}"), ("given_first_only", "{given_first}"), ("surname_only", "{surname}"),
    ("surname_last_only", "{surname_last}"), ("prefix_surname", "{prefix} {surname}"), ("surname_suffix", "{surname} {suffix}"),
    ("last_comma_first_from_core", "{core_last}, {core_first}"), ("given_first_middle_initials_surname", "{given_first} {middle} {surname}"),
]
SIMPLE = [("first_last", "{first} {last}"), ("last_comma_first", "{last}, {first}"), ("first_only", "{first}"), ("last_only", "{last}")]
CASES = ("raw", "uppercase", "lowercase", "titlecase")


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as SQL's upper has it: the length stays, and ß never meets SS."""
    one = F.create_map(*[F.lit(x) for c, u in ONE_UPPER.items() for x in (c, u)])
    letter = lambda c: F.when(c.isin(LONG_UPPER), F.coalesce(F.try_element_at(one, c), c)).otherwise(F.upper(c))
    return F.when(F.rlike(text, F.lit(f"[{''.join(LONG_UPPER)}]")), F.array_join(F.transform(F.split(text, ""), letter), "")).otherwise(F.upper(text))


def normalise_entry(s: Column) -> Column:
    """`a|b` is `a b`; runs of white space are one space."""
    return F.trim(F.regexp_replace(F.replace(s, F.lit("|"), F.lit(" ")), r"\s+", " "))


def fold_latin(s: Column) -> Column:
    return F.translate(s, ACCENTED, PLAIN)


def alias_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(fold_latin(s), "[^A-Za-z0-9]", ""))


def lookup_key(s: Column) -> Column:
    """Lower case, without punctuation at the ends but for ' and -."""
    return F.lower(F.regexp_replace(s, EDGE, ""))


def title_case(s: Column) -> Column:
    """Upper case after a space, hyphen or apostrophe and at the start, lower case elsewhere."""
    parted = F.regexp_replace(s, "([-'])", "$1\x01 ")  # a space that begins a word for initcap, and goes again
    return F.when(s.contains("-") | s.contains("'"), F.replace(F.initcap(parted), F.lit("\x01 "), F.lit(""))).otherwise(F.initcap(s))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda t: t != "")


def _leading(arr: Column, words: list[str]) -> Column:
    """How many elements at the start are among the words."""
    at = F.array_position(F.transform(arr, lambda x: ~lookup_key(x).isin(words)), True)
    return F.when(at == 0, F.size(arr)).otherwise(at.cast("int") - 1)


def has_special_structure(s: Column) -> Column:
    """A comma, a title or suffix, or a particle before the last word."""
    t = tokens(s)
    return s.contains(",") | F.exists(t, lambda x: lookup_key(x).isin(PREFIXES + SUFFIXES)) | F.exists(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda x: lookup_key(x).isin(PARTICLES))


def preserve_shape(s: Column) -> Column:
    """Whether the entry itself is a variant: one word, or two without special structure."""
    n = F.size(tokens(s))
    return (n <= 1) | (~has_special_structure(s) & (n <= 2))


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once, however often it stands in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def name_parts(e: Column) -> Column:
    """struct of the arrays prefix, given, surname, suffix and core.

    `surname, given` is taken apart at the first comma. Titles and suffixes are stripped; particles go with the surname; one
    word is both the given name and the surname. Each step is bound once, so that a filter pushed down doesn't multiply them.
    """
    part = lambda c, a, n: F.slice(c, a, F.greatest(n, F.lit(0)))
    none = F.array().cast("array<string>")
    has = e.contains(",")
    left, right = tokens(F.trim(F.substring_index(e, ",", 1))), tokens(F.trim(F.substr(e, F.locate(",", e) + 1)))

    def parts(b, pe, rest, sf, c, ss):
        n, comma = F.size(c), b["comma"]
        whole, one = ss >= n, n <= 1
        given = F.when(comma | one, c).when(whole, part(c, F.lit(1), F.lit(1))).otherwise(part(c, F.lit(1), n - ss))
        surname = F.when(comma, b["left"]).when(one | whole, c).otherwise(part(c, n - ss + 1, ss))
        return F.struct(part(b["base"], F.lit(1), pe).alias("prefix"), given.alias("given"), surname.alias("surname"), part(rest, F.size(rest) - sf + 1, sf).alias("suffix"), F.when(comma, F.concat(c, b["left"])).otherwise(c).alias("core"))

    def surnames(b, pe, rest, sf, c):
        return _let(_leading(part(F.reverse(c), F.lit(2), F.size(c) - 1), PARTICLES) + 1, lambda ss: parts(b, pe, rest, sf, c, ss))

    def cores(b, pe, rest, sf):
        return _let(F.when(F.size(rest) <= sf, b["base"]).otherwise(part(rest, F.lit(1), F.size(rest) - sf)), lambda c: surnames(b, pe, rest, sf, c))

    def based(b):
        return _let(_leading(b["base"], PREFIXES), lambda pe: _let(part(b["base"], pe + 1, F.size(b["base"]) - pe), lambda rest: _let(_leading(F.reverse(rest), SUFFIXES), lambda sf: cores(b, pe, rest, sf))))

    sides = F.struct(tokens(e).alias("t"), F.when(has, left).otherwise(none).alias("left"), F.when(has, right).otherwise(none).alias("right"))
    whole = lambda a: (F.size(a["left"]) > 0) & (F.size(a["right"]) > 0)
    return _let(sides, lambda a: _let(F.struct(whole(a).alias("comma"), F.when(whole(a), a["right"]).otherwise(a["t"]).alias("base"), a["left"].alias("left")), based))


def with_parts(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds the arrays prefix_t, given_t, surname_t, suffix_t, core_t."""
    d = df.withColumn("_n", name_parts(F.col(entry)))
    return d.withColumns({f"{k}_t": F.col(f"_n.{k}") for k in ("prefix", "given", "surname", "suffix", "core")}).drop("_n")


def split_name(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds given, surname, prefix and suffix as texts."""
    d = with_parts(df, entry)
    return d.withColumns({k: F.array_join(f"{k}_t", " ") for k in ("given", "surname", "prefix", "suffix")}).drop("prefix_t", "given_t", "surname_t", "suffix_t", "core_t")


def _first_of_each(arr: Column, key) -> Column:
    """The first element of each key, in order."""
    return _let(arr, lambda a: _let(F.transform(a, key), lambda k: F.filter(a, lambda x, i: F.array_position(k, key(x)) == i + 1)))


def _filled(pattern: str, parts: dict[str, Column]) -> Column:
    bits = [parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", pattern) if x]
    return F.concat(*bits) if len(bits) > 1 else bits[0]


def templates(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds `templates`, array<struct<id, text>> in fixed order, each text once."""
    first, last = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit("")), lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    d, e = with_parts(df, entry), F.col(entry)
    words = tokens(e)
    core = tokens(F.array_join("core_t", " "))
    rest = F.slice("given_t", F.lit(2), F.greatest(F.size("given_t") - 1, F.lit(0)))
    parts = {k: F.array_join(f"{k}_t", " ") for k in ("core", "given", "surname", "prefix", "suffix")} | {
        "given_first": first(F.col("given_t")), "surname_last": last(F.col("surname_t")), "core_first": first(core), "core_last": last(core), "first": first(words), "last": last(words),
        "middle": F.array_join(F.transform(rest, lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))), " ")}
    d = d.withColumns({f"_p_{k}": v for k, v in parts.items()} | {"_special": (F.size(words) > 0) & has_special_structure(e), "_keep": preserve_shape(e), "_many": F.size(words) >= 2})
    at = {k: F.col(f"_p_{k}") for k in parts}
    comma = e.contains(",")

    def made(name, pattern, holds):
        ok = reduce(and_, [at[x] != "" for x in re.findall(r"\{(\w+)\}", pattern)], holds)
        if name.startswith("last_comma_first"):
            ok = ok & ~comma & ((at["core_first"] != at["core_last"]) if name.endswith("core") else F.lit(True))
        return F.when(ok, F.struct(F.lit(name).alias("id"), _filled(pattern, at).alias("text")))

    special, simple = F.col("_special"), ~F.col("_special") & F.col("_many")
    every = F.array(F.struct(F.lit("canonical").alias("id"), e.alias("text")), *[made(*x, special) for x in SPECIAL], *[made(*x, simple) for x in SIMPLE])
    good = F.filter(every, lambda x: x.isNotNull() & (x["text"] != "") & (F.col("_keep") | (x["text"] != e)) & ~(comma & x["text"].contains(",")))
    d = d.withColumn("_all", good)
    return d.withColumn("templates", _first_of_each(F.col("_all"), lambda x: x["text"])).drop(*[c for c in d.columns if c not in df.columns])


def orthographic(token: Column) -> Column:
    """array<struct<text, alias, shape>>: the folded token, and hyphens as spaces, spaces as hyphens, and neither."""
    folded = fold_latin(token)
    r = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    none = F.lit(None).cast("string")
    shapes = [r(token, "-", " "), r(token, " ", "-"), r(token, "-", ""), r(token, " ", ""), r(folded, "-", " "), r(folded, " ", "-")]
    one = lambda x, k: F.struct(normalise_entry(x).alias("text"), none.alias("alias"), F.lit(k).alias("shape"))
    made = F.array(F.when(folded != token, one(folded, "latin_fold")), *[F.when(x != "", one(x, "token_shape")) for x in shapes])
    return F.filter(made, lambda x: x.isNotNull() & (x["text"] != ""))


def shapes(entry: Column) -> Column:
    """The entry, with spaces for hyphens, with hyphens for spaces, and without hyphens, each once."""
    r = lambda a, b: F.replace(entry, F.lit(a), F.lit(b))
    return F.array_distinct(F.array(entry, r("-", " "), r(" ", "-"), r("-", "")))


def _token_variants(token: Column, aliases: Column) -> Column:
    """The token, its shapes, its aliases and their shapes: each text once, MAX_TOKEN at most."""
    none = F.lit(None).cast("string")
    own = F.concat(F.array(F.struct(token.alias("text"), none.alias("alias"), none.alias("shape"))), orthographic(token))
    other = F.flatten(F.transform(aliases, lambda a: F.concat(F.array(F.struct(normalise_entry(a).alias("text"), alias_key(token).alias("alias"), none.alias("shape"))), orthographic(a))))
    return F.slice(_first_of_each(F.concat(own, other), lambda x: x["text"]), 1, MAX_TOKEN)


def role_templates(df: DataFrame, aliases: DataFrame | None = None, entry: str = "entry") -> DataFrame:
    """Adds `roles`, array<struct<id, text, alias, shape>>: pairs of variants of the given names and of the surnames, in both orders.

    aliases: role (given or surname), key (as `alias_key` makes it), alias and place, its order within the key; a caller's
    table of bounded size (100,000 rows at most), sent along as one map. Only entries have pairs in which a token has an
    accent, a hyphen or an alias.
    """
    if aliases is not None and aliases.limit(100_001).count() > 100_000:
        raise ValueError("the alias table is too large")
    empty = F.create_map().cast("map<string,array<string>>")
    d = with_parts(df, entry)
    if aliases is None:
        d = d.withColumn("_a", empty)
    else:
        each = aliases.groupBy("role", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("v"))
        one = each.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "role", "key").alias("k"), "v"))).alias("_a"))
        d = d.crossJoin(F.broadcast(one))  # one row
    of = lambda role, x: F.coalesce(F.try_element_at("_a", F.concat(F.lit(role + ":"), alias_key(x))), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    d = d.withColumns({"_g": F.transform("given_t", lambda x, i: F.struct(x.alias("t"), F.when(i == 0, of("given", x)).otherwise(none).alias("a"))), "_s": F.transform("surname_t", lambda x: F.struct(x.alias("t"), of("surname", x).alias("a")))})
    signal = lambda c: F.exists(c, lambda x: (fold_latin(x["t"]) != x["t"]) | x["t"].contains("-") | (F.size(x["a"]) > 0))
    kind = "array<array<struct<text:string,alias:string,shape:string>>>"

    def side(c):
        grown = F.aggregate(F.transform(c, lambda x: _token_variants(x["t"], x["a"])), F.array(F.array()).cast(kind), lambda states, vs: F.slice(F.flatten(F.transform(states, lambda s: F.transform(vs, lambda v: F.concat(s, F.array(v))))), 1, MAX_SIDE))
        joined = lambda s, k: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(s, lambda v: v[k]), lambda x: x.isNotNull()))), ",")
        made = F.transform(grown, lambda s: F.struct(F.array_join(F.transform(s, lambda v: v["text"]), " ").alias("text"), joined(s, "alias").alias("alias"), joined(s, "shape").alias("shape")))
        return F.slice(_first_of_each(made, lambda x: x["text"]), 1, MAX_SIDE)

    d = d.withColumns({"_gs": side(F.col("_g")), "_ss": side(F.col("_s")), "_on": (F.size(tokens(F.col(entry))) >= 2) & (F.size("given_t") > 0) & (F.size("surname_t") > 0) & (signal("_g") | signal("_s"))})
    both = lambda g, s, k: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(g[k], s[k]), lambda x: x != ""))), ",").alias(k)
    pair = lambda name, text, g, s: F.struct(F.lit(name).alias("id"), text.alias("text"), both(g, s, "alias"), both(g, s, "shape"))
    pairs = F.flatten(F.transform("_gs", lambda g: F.flatten(F.transform("_ss", lambda s: F.array(
        pair("role_alias_pair", F.concat_ws(" ", g["text"], s["text"]), g, s), pair("role_alias_comma_pair", F.concat_ws(", ", s["text"], g["text"]), g, s))))))
    d = d.withColumn("roles", F.when(F.col("_on"), F.slice(pairs, 1, MAX_PAIRS)).otherwise(F.array().cast("array<struct<id:string,text:string,alias:string,shape:string>>")))
    return d.drop(*[c for c in d.columns if c not in df.columns and c != "roles"])


def together(df: DataFrame, entry: str = "entry", idx: str = "entry_idx") -> DataFrame:
    """entry and ids, an array of structs of idx: what an entry makes is made once for equal entries.

    A frequent entry has as many rows as the session has shuffle partitions, over which all rows are dealt out.
    """
    part = F.pmod(F.xxhash64(idx), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    d = spread(df.select(F.col(entry), F.col(idx), part.alias("_part")), entry, "_part")
    return d.groupBy(entry, "_part").agg(F.collect_list(F.struct(idx)).alias("ids")).drop("_part")


def case_variants(text: Column) -> Column:
    """array<struct<case, text>>: raw, upper, lower, title, each text once, under its first case."""
    made = F.array(*[F.struct(F.lit(k).alias("case"), v.alias("text")) for k, v in zip(CASES, (text, F.upper(text), F.lower(text), title_case(text)))])
    return _first_of_each(made, lambda x: x["text"])


def family(text: Column) -> Column:
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    other = F.length(F.regexp_replace(t, r"[A-Za-z0-9\s]", ""))
    words = tokens(t)
    few = lambda w, n: (F.length(F.regexp_replace(w, "[^A-Za-z]", "")) <= n) | w.endswith(".")
    return (F.when(t == "", "empty").when(t.contains(","), "comma").when(other > letters, "punctuation_heavy")
        .when(F.size(words) == 1, F.when(few(t, 2), "initial").otherwise("single_token")).when(F.exists(words, lambda w: few(w, 1)), "initial").otherwise("plain_multi_token"))


def skipped(entry: Column, variant_family: Column) -> Column:
    """The runtime policy: no variants of the comma family, and no single words made of entries of several."""
    return (variant_family == "comma") | ((variant_family == "single_token") & (F.size(tokens(entry)) >= 2))


def variants(df: DataFrame, entry: str = "entry", aliases: DataFrame | None = None, roles: bool = True) -> DataFrame:
    """Adds `variants`, array<struct<template, alias, shape, case, text>> of each entry before policy and caps, each text once."""
    d, none = templates(df, entry), F.lit("")
    made = F.transform("templates", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"), none.alias("alias"), none.alias("shape")))
    if roles:
        d = role_templates(d, aliases, entry)
        e, keep = F.col(entry), preserve_shape(F.col(entry))
        good = F.filter("roles", lambda x: (keep | (x["text"] != e)) & ~(e.contains(",") & x["text"].contains(",")))
        made = _first_of_each(F.concat(made, good), lambda x: x["text"])
    d = d.withColumn("_made", made)
    cased = F.flatten(F.transform("_made", lambda t: F.transform(case_variants(t["text"]), lambda c: F.struct(t["id"].alias("template"), t["alias"].alias("alias"), t["shape"].alias("shape"), c["case"].alias("case"), c["text"].alias("text")))))
    d = d.withColumn("_cased", cased)
    return d.withColumn("variants", _first_of_each(F.col("_cased"), lambda x: x["text"])).drop("templates", "roles", "_made", "_cased")


def expand(entries: DataFrame, entry: str = "entry", idx: str = "entry_idx", runtime_policy: bool = True, limit: int = MAX_VARIANTS, aliases: DataFrame | None = None, roles: bool = True) -> DataFrame:
    """entry_idx, variant_idx, text, template, family, alias, shape, case: variants of each entry, the first of equal texts over all entries.

    Equal entries make equal variants, so that the first of them alone is expanded; those are dealt out over all shuffle partitions.
    """
    e = entries.select(F.col(idx).alias("entry_idx"), normalise_entry(F.col(entry)).alias("entry"))
    first = F.when(F.count("entry_idx") == F.count("*"), F.min("entry_idx"))  # null comes first
    e = spread(e.groupBy("entry").agg(first.alias("entry_idx")), "entry_idx", "entry")  # by the entry alone it would be the shuffle that there is, and not dealt out
    d = variants(e, aliases=aliases, roles=roles)
    d = d.withColumn("variants", F.transform("variants", lambda v: v.withField("family", family(v["text"]))))
    kept = F.filter("variants", lambda v: ~skipped(F.col("entry"), v["family"])) if runtime_policy else F.col("variants")
    # outer: the filter that Spark infers for the other kind is pushed down and works all parts out again
    each = d.select("entry_idx", F.posexplode_outer(F.slice(kept, 1, limit)).alias("variant_idx", "v")).where("v is not null").select("entry_idx", "variant_idx", "v.text", "v.template", "v.family", "v.alias", "v.shape", "v.case")
    first = Window.partitionBy("text").orderBy("entry_idx", "variant_idx")
    return each.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def role_aliases(names: DataFrame, aliases: DataFrame, limit: int = MAX_TOKEN) -> DataFrame:
    """Joins names (entry_idx, given, surname) with a caller's alias table (key, alias) on the folded given name."""
    j = names.withColumn("key", alias_key(F.col("given"))).join(aliases, "key")
    w = Window.partitionBy("entry_idx").orderBy("alias")
    return j.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("entry_idx", F.concat_ws(" ", "alias", "surname").alias("text"))


def merge_sources(sources: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(sources)), ",")
