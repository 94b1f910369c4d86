"""Operator 2, benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become templates: numbers, quantities with a unit, units and names turn into typed placeholders, other words into
lower case. Windows of five template words are hashed and joined. Matches of a document with an item on one diagonal
(document position less item position) must fill the item's slots consistently: one value of the item may stand for one
value of the document only, the one that most of its places on the diagonal have. Windows with another value, and all
changed ones of a tie, don't count; unchanged values always do. An item leaks into a document if windows with consistent slots cover at least MIN_COVERAGE of
the item's words, whatever numbers, names and units were put in its place.

The windows of the benchmark are broadcast as bare hashes if there are BROADCAST_ROWS at most, and joined by a shuffle
beyond that; document windows are dropped in the stage that makes them.

Item windows with placeholders are looked up by their own words too, since a template of placeholders mostly (fewer than
MIN_WORDS plain words) says nothing and is not used. An item of fewer than five words is one window of its whole length,
looked up by its words, and by its template if that has placeholders and MIN_WORDS plain words. Documents are searched
for just those lengths that the benchmark asks for.

Cases: null and empty texts have no windows; an item without words is never found; null ids match
like other rows and are returned as null; repeated rows give one result row for each distinct (doc_id, text) and item;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, table

WINDOW, MIN_WORDS, MIN_COVERAGE = 5, 3, 0.8
BROADCAST_ROWS = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
NUMBER = r"^[0-9]+([.,:/][0-9]+)*$"
QUANTITY = r"^[0-9]+([.,][0-9]+)*[A-Za-z]{1,3}$"
NAME = r"^[A-Z][a-z]+$"
GOES_ON = r"[\p{L}\p{N},;]$"  # how a word ends that doesn't end a sentence
UNITS = "mm cm km kg mg lb oz ml mph kph hz khz mhz ghz kb mb gb tb meter meters metre metres kilometer kilometers mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split()
MARK = "\x01"


def template(text: Column) -> Column:
    """array<struct<t,v>>: the template words t (placeholders begin with MARK) with their own words v."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")
    before = F.slice(F.concat(F.array(F.lit(".")), raw), F.lit(1), F.size(raw))

    # two steps, since a lambda works out an expression as often as it stands in it
    cores = F.zip_with(raw, before, lambda x, prev: F.struct(F.regexp_replace(x, EDGES, "").alias("c"), prev.alias("p")))

    def word(s):
        c, low = s["c"], F.lower(s["c"])
        digit, capital = (c >= "0") & (c < ":"), (c >= "A") & (c < "[")  # by its first character, before any pattern is tried
        kind = (
            F.when(digit & F.rlike(c, F.lit(NUMBER)), F.lit(MARK + "n")).when(digit & F.rlike(c, F.lit(QUANTITY)), F.lit(MARK + "q")).when(low.isin(UNITS), F.lit(MARK + "u"))
            .when(capital & F.rlike(c, F.lit(NAME)) & F.rlike(s["p"], F.lit(GOES_ON)), F.lit(MARK + "p")).otherwise(low)
        )
        return F.struct(kind.alias("t"), low.alias("v"))

    return F.filter(F.transform(cores, word), lambda s: s["v"] != "")


def _slot(s: Column) -> Column:
    return F.startswith(s["t"], F.lit(MARK))


def windows(rows: DataFrame, keep: list[str], ways=((WINDOW, False),), items: bool = False) -> DataFrame:
    """Of rows with a column `words` (a template): the columns keep, `pos` (from 0), `hash` and `slotted`, for each window.

    slotted: the window's words if a placeholder is among them, else null; the text's array itself is not carried along.
    ways: pairs of a length and whether windows are hashed by their own words; those have slotted in items only. Items
    also get the columns `size` and `exact`, the way, and have windows below WINDOW words only if that is their whole length.
    """
    d = rows.withColumns({"_h": F.transform("words", lambda s: F.xxhash64(s["t"])), "_any": F.exists("words", _slot)})
    if any(exact for _, exact in ways):
        d = d.withColumn("_v", F.transform("words", lambda s: F.xxhash64(s["v"])))
    none = F.lit(None).cast("array<struct<t:string,v:string>>")

    def made(size, exact):
        has = F.size("words") == size if items and size < WINDOW else F.size("words") >= size
        at = F.when(has, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array().cast("array<int>"))

        def one(i):
            own, hashes = F.slice("words", i + 1, size), F.slice("_v" if exact else "_h", i + 1, size)
            way = [] if (size, exact) == (WINDOW, False) else [F.lit(size), F.lit(exact)]  # hashes of different ways don't meet
            slotted = F.when(F.col("_any") & F.exists(own, _slot), own) if items or not exact else none
            return F.struct(i.alias("pos"), F.xxhash64(hashes, *way).alias("hash"), slotted.alias("slotted"), *([F.lit(size).alias("size"), F.lit(exact).alias("exact")] if items else []))

        return F.transform(at, one)

    every = [made(*way) for way in ways]
    return d.select(*keep, F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("_w")).select(*keep, "_w.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, _key (a hash of the text), item_id, n_windows, coverage, n_slots, reparameterised of each leak."""
    items = plain(benchmark, item_id=item_id, text=item_text).distinct().select("item_id", template(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    slotted = F.col("slotted").isNotNull()
    plenty = F.size(F.filter("slotted", lambda s: ~_slot(s))) >= MIN_WORDS
    short = F.col("size") < WINDOW
    used = F.when(F.col("exact"), slotted | short).otherwise(F.when(slotted, plenty).otherwise(~short))
    every = [(n, exact) for n in range(1, WINDOW + 1) for exact in (False, True)]
    seen = cut(windows(items, ["item_id", "n_words"], every, items=True).where(used), "items")
    ways = {(r["size"], r["exact"]): r["count"] for r in seen.groupBy("size", "exact").count().collect()}  # ten rows at most
    d = plain(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("_key"), template(F.col("text")).alias("words"))
    known = seen.select("hash").distinct()
    known = F.broadcast(known) if sum(ways.values()) <= BROADCAST_ROWS else known.hint("shuffle_hash")
    met = windows(d, ["doc_id", "_key"], sorted(ways) or ((WINDOW, False),)).join(known, "hash", "left_semi").select("doc_id", "_key", "hash", F.col("pos").alias("dpos"), F.col("slotted").alias("dw"))
    met = cut(met, "met")
    pairs = met.join(seen.select("item_id", "n_words", "hash", F.col("pos").alias("ipos"), F.col("slotted").alias("iw"), "exact"), "hash").withColumn("dw", F.when(F.col("exact"), F.col("iw")).otherwise(F.col("dw")))
    zipped = F.coalesce(F.arrays_zip("iw", "dw"), F.array().cast("array<struct<iw:struct<t:string,v:string>,dw:struct<t:string,v:string>>>"))
    slots = F.filter(F.transform(zipped, lambda z, k: F.struct((F.col("ipos") + k).alias("p"), z["iw"]["v"].alias("i"), z["dw"]["v"].alias("d"), _slot(z["iw"]).alias("s"))), lambda z: z["s"])
    by_diagonal = pairs.groupBy("doc_id", "_key", "item_id", "n_words", (F.col("dpos") - F.col("ipos")).alias("_d")).agg(F.collect_set(F.struct(F.col("ipos").alias("at"), slots.alias("slots"))).alias("met"))
    # how many places of the item have each pair of values, and the pairs that may stand
    places = F.array_distinct(F.flatten(F.col("met.slots")))
    pair = lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d"))
    counted = F.transform(F.array_distinct(F.transform("places", pair)), lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"), F.size(F.filter("places", lambda s: (s["i"] == x["i"]) & (s["d"] == x["d"]))).alias("n")))
    stands = F.filter("counted", lambda x: (x["i"] == x["d"]) | ~F.exists("counted", lambda y: (y["i"] == x["i"]) & (y["d"] != x["d"]) & (y["n"] >= x["n"])))
    judged = by_diagonal.withColumn("places", places).withColumn("counted", counted).withColumn("stands", F.transform(stands, pair))
    fits = judged.withColumn("met", F.filter("met", lambda w: F.forall(w["slots"], lambda s: F.array_contains("stands", pair(s)))))
    fits = fits.where(F.size("met") > 0).select("doc_id", "_key", "item_id", "n_words", F.col("met.at").alias("at"), F.transform(F.flatten(F.col("met.slots")), pair).alias("slots"))
    by_item = fits.groupBy("doc_id", "_key", "item_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.flatten(F.collect_list("slots")).alias("slots"))
    words = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.least(F.lit(WINDOW), F.col("n_words")) - 1))))
    out = by_item.select("doc_id", "_key", "item_id", F.size("at").cast("long").alias("n_windows"), F.round(F.size(words) / F.col("n_words"), 6).alias("coverage"),
        F.size(F.array_distinct("slots")).cast("long").alias("n_slots"), F.exists("slots", lambda s: s["i"] != s["d"]).alias("reparameterised"))
    return out.where(F.col("coverage") >= min_coverage)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, as they are."""
    bad = cut(contaminated(docs, benchmark).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("_key").alias("_text")).distinct(), "leaks")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_mark_id"), F.xxhash64("text").alias("_mark_text"))
    return d.join(bad, (F.col("_mark_id") == F.col("_id")) & (F.col("_mark_text") == F.col("_text")), "left_anti").select("_row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


_TEMPLATE_SQL = """
    select id, body, list_filter(list_transform(range(1, len(raw) + 1), lambda i: struct_pack(
        v := lower(regexp_replace(raw[i], '{EDGES}', '', 'g')),
        t := case
            when regexp_matches(regexp_replace(raw[i], '{EDGES}', '', 'g'), '{NUMBER}') then chr(1) || 'n'
            when regexp_matches(regexp_replace(raw[i], '{EDGES}', '', 'g'), '{QUANTITY}') then chr(1) || 'q'
            when list_contains([{UNITS}], lower(regexp_replace(raw[i], '{EDGES}', '', 'g'))) then chr(1) || 'u'
            when i > 1 and regexp_matches(regexp_replace(raw[i], '{EDGES}', '', 'g'), '{NAME}') and regexp_matches(raw[i - 1], '{GOES_ON}') then chr(1) || 'p'
            else lower(regexp_replace(raw[i], '{EDGES}', '', 'g')) end)), lambda s: s.v <> '') as words
    from (select {id} as id, text as body, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as raw from {table})
"""


def _template_sql(name: str, id_: str) -> str:
    out = _TEMPLATE_SQL
    for k, v in {"EDGES": EDGES, "NUMBER": NUMBER, "QUANTITY": QUANTITY, "NAME": NAME, "GOES_ON": GOES_ON, "SPACE": SPACE, "UNITS": ", ".join(f"'{u}'" for u in UNITS), "id": id_, "table": name}.items():
        out = out.replace("{" + k + "}", v)
    return out


ORACLE_SQL = {
    "op2_decontamination": f"""
with d as ({_template_sql('documents', 'doc_id')}), b as ({_template_sql('benchmark', 'item_id')}),
dwin as (select distinct id, body, p, words[p:p + 4] as w from (select id, body, words, unnest(range(1, len(words) - 3)) as p from d)),
bwin as (select distinct id, len(words) as n_words, p, words[p:p + 4] as w from (select id, words, unnest(range(1, len(words) - 3)) as p from b)),
dk as (select *, array_to_string(list_transform(w, lambda s: s.t), ' ') as k from dwin),
bk as (select *, array_to_string(list_transform(w, lambda s: s.t), ' ') as k from bwin where len(list_filter(w, lambda s: s.t[1] = chr(1))) <= 2),
m as (select dk.id as doc_id, dk.body, bk.id as item_id, n_words, dk.p - bk.p as diag, bk.p as ipos,
        list_transform(list_filter([1, 2, 3, 4, 5], lambda i: bk.w[i].t[1] = chr(1)), lambda i: struct_pack(i := bk.w[i].v, d := dk.w[i].v)) as slots
      from dk join bk using (k)),
diag as (select doc_id, body, item_id, n_words, list_distinct(list(ipos)) as hits, list_distinct(flatten(list(slots))) as slots from m group by doc_id, body, item_id, n_words, diag),
fits as (select * from diag where len(slots) = len(list_distinct(list_transform(slots, lambda s: s.i)))),
item as (select doc_id, body, item_id, n_words, list_distinct(flatten(list(hits))) as hits, list_distinct(flatten(list(slots))) as slots from fits group by doc_id, body, item_id, n_words)
select doc_id, item_id, len(hits)::bigint as n_windows,
    round(len(list_distinct(flatten(list_transform(hits, lambda p: range(p, p + 5))))) / n_words, 6) as coverage,
    len(slots)::bigint as n_slots, len(list_filter(slots, lambda s: s.i <> s.d)) > 0 as reparameterised
from item where round(len(list_distinct(flatten(list_transform(hits, lambda p: range(p, p + 5))))) / n_words, 6) >= 0.8
"""
}
