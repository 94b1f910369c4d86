"""Operator 13, MinHash near-duplicates by an inverted join on signature coordinates.

Texts with the same set of shingles are one class. A class's signature holds, for each of COORDINATES hash functions, the
least hash of its shingles; two sets agree in a coordinate with the probability of their Jaccard similarity. Each class is
posted under every pair of coordinate and value. Two signatures that agree in MATCHES coordinates or more share one at
least of the COORDINATES - MATCHES + 1 rarest of either, so only these are joined (prefix), pairs whose set sizes rule the
similarity out are skipped, and the coordinates that agree are counted on the signatures of the pairs that are left. Pairs
with MATCHES agreements or more are confirmed on their full sets. At a similarity of 0.8 fewer agree with a probability of 3e-7.

Lists of more than LARGE classes don't give all their pairs. First each class of such a list meets a few pivots, which
similar lists share: the class whose tokens are the commonest, and those of least hash; the links found join classes to
components, within which no pair is looked at any more. In a list that still holds two components or more the classes outside
of its commonest one are compared with all of it, in blocks of about BLOCK classes, each pair of blocks a task's unit:
by signatures first, then, for those that agree often enough with a class of another component, by their full sets in
the task itself, which gives a forest of links and no pairs. No pair of different components is left out.

Cases: null and empty texts and those without words have n_shingles 0 and a component of their own; rows are kept one for
one, repeated and null doc_ids included; component_id is the least non-null doc_id of the component (null if it has none),
and kept holds where doc_id is that. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, skewed_lookup, table
from .components import components
from .shingles import mix, shingle_hashes, words_of

SHINGLE, PERCENT = 4, 80
COORDINATES, MATCHES = 64, 34  # coordinates have a bit each in a long: 64 at most
LARGE, PIVOTS, BLOCK = 48, 4, 512
BROADCAST_KEYS = 1_000_000
_SLICE = 1 << 15


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(words_of(text, lower=True), k))


def factors(n: int) -> np.ndarray:
    """n odd multipliers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> list[np.ndarray | None]:
    """Of each set the least value of each hash function: upper halves of h * factor, as 32-bit integers; None of an empty set.

    Small sets are worked out together, long ones in slices.
    """
    out: list = [None] * len(sets)
    by = factors(coordinates)

    def together(at: list[int]) -> None:
        h = np.concatenate([sets[i] for i in at])
        starts = np.cumsum([0] + [len(sets[i]) for i in at[:-1]])
        with np.errstate(over="ignore"):
            least = np.stack([np.minimum.reduceat(h * a, starts) for a in by], 1)
        for i, row in zip(at, (least >> np.uint64(32)).astype(np.uint32).view(np.int32)):
            out[i] = row

    def sliced(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = np.array([min((h[x : x + _SLICE] * a).min() for x in range(0, len(h), _SLICE)) for a in by], np.uint64)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)

    waiting, size = [], 0
    for i, h in enumerate(sets):
        if len(h) > _SLICE:
            out[i] = sliced(h)
        elif len(h):
            waiting.append(i)
            size += len(h)
            if size > _SLICE:
                together(waiting)
                waiting, size = [], 0
    if waiting:
        together(waiting)
    return out


def _sketches(k: int, coordinates: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            keys, sizes = [hashlib.md5(h.tobytes(), usedforsecurity=False).digest() for h in sets], list(map(len, sets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures(sets, coordinates), pa.list_(pa.int32()))], names=["doc_id", "text_key", "set_key", "n", "signature"])

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(sets, pa.list_(pa.int64()))], names=["class", "items"])

    return run


def _similar(a, b, percent):
    """Set sizes that leave the similarity possible."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class Join:
    """The signature-coordinate join of one table of documents."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, large: int = LARGE, block: int = BLOCK):
        self.k, self.percent, self.coordinates, self.matches, self.large, self.block = k, percent, coordinates, matches, large, block
        self.docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
        self.rows = cut(self.docs.mapInArrow(_sketches(k, coordinates), "doc_id long, text_key long, set_key binary, n long, signature array<int>"), "sketches")
        some = self.rows.where("n > 0").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("of"), F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("signature").alias("signature"))
        self.classes = cut(some.withColumn("class", F.monotonically_increasing_id()), "classes")

    def postings(self) -> DataFrame:
        """class, n, weight, mask, token and how many classes the token has, for the rarest tokens of each class.

        mask: a bit for each coordinate whose token is among these and has more than LARGE classes.
        weight: how many classes its tokens have in all. Of near copies the one that most others were made from has the most.
        """
        tokens = self.classes.select("class", F.posexplode("signature").alias("at", "value")).select("class", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
        counts = tokens.groupBy("token").agg(F.count("*").alias("of_token")).where("of_token > 1")
        shared = skewed_lookup(tokens, counts, ["token"], name="tokens").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("of_token", "token"))).alias("ts"), F.sum("of_token").alias("weight"))
        # tokens of one class alone are the rarest and join nothing: of the others size - matches + 1 are left to the prefix
        rare = shared.where(F.size("ts") >= self.matches).select("class", "weight", F.slice("ts", F.lit(1), F.size("ts") - self.matches + 1).alias("ts"))
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t["token"], 32).cast("int"))
        mask = F.aggregate(F.filter("ts", lambda t: t["of_token"] > self.large), F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(bit(t)))
        rare = rare.select("class", "weight", mask.alias("mask"), F.explode("ts").alias("t"))
        return cut(rare.select("class", "weight", "mask", "t.*").join(self.classes.select("class", "n").hint("shuffle_merge"), "class"), "postings")

    def small_pairs(self, postings: DataFrame) -> DataFrame:
        """Pairs of different labels in lists of LARGE classes at most."""
        p = postings.where(F.col("of_token") <= self.large).select("token", "class", "label", "n")
        a, b = p.alias("a"), p.alias("b")
        on = (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.label") != F.col("b.label")) & _similar(F.col("a.n"), F.col("b.n"), self.percent)
        return a.join(b.hint("shuffle_merge"), on).select(F.col("a.class").alias("u"), F.col("b.class").alias("v"))

    def pivot_pairs(self, postings: DataFrame) -> DataFrame:
        p = postings.where(F.col("of_token") > self.large).select("token", "class", "n", "weight")
        least = lambda h: F.min(F.struct(h.alias("h"), "class", "n"))
        pivots = p.groupBy("token").agg(F.array(least(-F.col("weight")), *[least(F.xxhash64("class", F.lit(s))) for s in range(PIVOTS - 1)]).alias("pivots"))
        of = F.array_distinct(F.flatten(F.collect_list(F.transform("pivots", lambda x: F.struct(x["class"].alias("class"), x["n"].alias("n"))))))  # a few for each token, mostly the same
        met = skewed_lookup(p, pivots, ["token"], name="pivots").groupBy("class", "n").agg(of.alias("pivots")).select("class", "n", F.explode("pivots").alias("p")).where((F.col("class") != F.col("p.class")) & _similar(F.col("n"), F.col("p.n"), self.percent))
        return met.select(F.least("class", "p.class").alias("u"), F.greatest("class", "p.class").alias("v"))

    def _with(self, pairs: DataFrame, right: DataFrame, column: str) -> DataFrame:
        """pairs with the column of both ends."""
        for end in ("u", "v"):
            pairs = pairs.join(right.select(F.col("class").alias(end), F.col(column).alias(f"{column}_{end}")).hint("shuffle_merge"), end)
        return pairs

    def enough(self, pairs: DataFrame) -> DataFrame:
        """Pairs u, v whose signatures agree in `matches` coordinates or more."""
        d = self._with(pairs.distinct(), self.classes, "signature")
        agree = F.size(F.filter(F.zip_with("signature_u", "signature_v", lambda a, b: a == b), lambda x: x))
        return cut(d.where(agree >= self.matches).select("u", "v"), "candidates")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """class and items (the full set) of the wanted classes."""
        wanted = cut(self.classes.join(wanted.select("class").distinct().hint("shuffle_merge"), "class").select("class", "of.doc_id", "of.text_key"), "wanted")
        few = wanted.count() <= BROADCAST_KEYS
        d, w = self.docs.alias("d"), (F.broadcast(wanted) if few else wanted.hint("shuffle_merge")).alias("w")
        texts = d.join(w, (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.class", "d.text")
        return cut(texts.mapInArrow(_sets(self.k), "class long, items array<long>").groupBy("class").agg(F.first("items").alias("items")), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Of candidates u, v those whose full sets are similar enough."""
        d = self._with(pairs, self.sets(pairs.select(F.col("u").alias("class")).union(pairs.select("v"))), "items")
        both = F.size(F.array_intersect("items_u", "items_v"))
        return cut(d.withColumn("both", both).where(100 * F.col("both") >= self.percent * (F.size("items_u") + F.size("items_v") - F.col("both"))).select("u", "v"), "links")

    def block_links(self, postings: DataFrame) -> DataFrame | None:
        """Links u, v between labels in each list of more than LARGE classes and more than one label, a forest of each block.

        The classes of a list's commonest label don't meet each other: the others, the askers, meet all of the list, by
        signature first; the blocks of those that agree often enough with one of another label then get their full sets.
        """
        p = postings.where(F.col("of_token") > self.large).select("token", "class", "label", "n", "mask")
        most = p.groupBy("token", "label").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("size")).where("size > top.size")
        p = skewed_lookup(p, most.select("token", "size", (F.col("size") - F.col("top.size")).alias("askers"), F.col("top.label").alias("common")), ["token"], name="mixed")
        blocks = lambda n: F.ceil(F.col(n) / self.block).cast("long")
        p = p.select("token", "class", "label", "n", "mask", (F.col("label") != F.col("common")).alias("asks"), blocks("askers").alias("ka"), blocks("size").alias("ks"))
        spread = lambda k: F.pmod(F.xxhash64("class", F.lit(1)), F.col(k))
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
        asking = p.where("asks").select("token", "class", "label", "n", "mask", "asks", spread("ka").alias("a"), every("ks").alias("b"))
        asked = p.select("token", "class", "label", "n", "mask", F.lit(False).alias("asks"), every("ka").alias("a"), spread("ks").alias("b"))
        units = asking.union(asked).select(F.xxhash64("token", "a", "b").alias("unit"), F.shiftright("token", 32).cast("int").alias("at"), "class", "label", "n", "mask", "asks")
        signed = self.classes.select("class", "signature").hint("shuffle_merge")
        shape = "unit long, at int, class long, label long, n long, mask long, asks boolean"
        met = cut(units.join(signed, "class").groupBy("unit").applyInArrow(_block(self.matches, self.percent, False), shape), "met")
        if met.isEmpty():
            return None
        full = met.join(signed, "class").join(self.sets(met).hint("shuffle_merge"), "class")
        return cut(full.groupBy("unit").applyInArrow(_block(self.matches, self.percent, True), "u long, v long").distinct(), "block-links")

    def labels(self) -> DataFrame:
        """class and label of every class: the least class that similar pairs join it to."""

        def labelled(edges):
            stars = components(edges)
            return stars, cut(self.classes.select("class").join(stars.withColumnRenamed("node", "class").hint("shuffle_merge"), "class", "left").select("class", F.coalesce("label", "class").alias("label")), "labels")

        postings = self.postings()
        stars, label = labelled(self.confirm(self.enough(self.pivot_pairs(postings))))
        postings = cut(skewed_lookup(postings, label, ["class"], name="labels"), "postings")
        found = stars.select(F.col("label").alias("u"), F.col("node").alias("v")).where("u <> v").union(self.confirm(self.enough(self.small_pairs(postings))))
        more = self.block_links(postings)
        return labelled(found if more is None else found.union(more))[1]


def _block(matches: int, percent: int, full: bool):
    """Task function over a unit: the classes that agree often enough with one of another label or, with full sets, the links between labels."""

    def run(t: pa.Table) -> pa.Table:
        ids, labels, n, asks = (t.column(c).to_numpy() for c in ("class", "label", "n", "asks"))
        s = t.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        bits = (t.column("mask").to_numpy().view(np.uint64)[:, None] >> np.arange(s.shape[1], dtype=np.uint64) & np.uint64(1)).astype(bool)
        at = t.column("at")[0].as_py()
        data = np.flatnonzero(~asks)
        items = t.column("items").combine_chunks() if full else None
        top = {int(x): int(x) for x in labels}

        def root(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        met, us, vs = np.zeros(len(ids), bool), [], []
        for i in np.flatnonzero(asks):
            equal = s[data] == s[i]
            agree = equal.sum(1)
            # a pair is looked at in one list alone, that of the first coordinate by which both are in a long list
            own_list = (equal & bits[data] & bits[i]).argmax(1) == at
            fits = own_list & (agree >= matches) & (labels[data] != labels[i]) & (100 * np.minimum(n[i], n[data]) >= percent * np.maximum(n[i], n[data]))
            j = data[fits]
            if not len(j):
                continue
            met[i] = True
            met[j] = True
            if full:
                own = items[i].values.to_numpy()
                for k in j[np.argsort(-agree[fits], kind="stable")]:
                    if root(int(labels[i])) == root(int(labels[k])):
                        continue
                    both = len(np.intersect1d(own, items[int(k)].values.to_numpy(), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[k] - both):
                        top[root(int(labels[i]))] = root(int(labels[k]))
                        us.append(min(ids[i], ids[k]))
                        vs.append(max(ids[i], ids[k]))
        if full:
            return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
        return t.filter(pa.array(met)).select(["unit", "at", "class", "label", "n", "mask", "asks"])

    return run


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    j = Join(plain(docs, doc_id=doc_id, text=text), **how)
    of = j.classes.join(j.labels().hint("shuffle_merge"), "class").select("set_key", "first_doc", "label")
    least = of.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of = of.join(least.hint("shuffle_merge"), "label").select("set_key", "component_id")
    some = skewed_lookup(j.rows.where("n > 0").select("doc_id", "n", "set_key"), of, ["set_key"], name="components").select("doc_id", "n", "component_id")
    every = some.union(j.rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END)) AS items FROM w),
c AS MATERIALIZED (SELECT items, min(doc_id) AS class, any_value(len(items)) AS n FROM s WHERE len(items) > 0 GROUP BY items),
g AS MATERIALIZED (SELECT class, n, unnest(items) AS g FROM c),
p AS MATERIALIZED (
  SELECT a.class AS u, b.class AS v FROM g a JOIN g b ON a.g = b.g AND a.class < b.class
  GROUP BY a.class, b.class HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT class AS a, class AS b FROM c UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
l AS (SELECT a AS class, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.items = c.items LEFT JOIN l ON c.class = l.class"""
}
