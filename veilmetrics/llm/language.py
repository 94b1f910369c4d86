"""Operator 7, language identification by rank-order profiles.

The letter n-grams (n = 1 to 3, word ends as spaces) of a text are ranked by frequency. A language profile is the ranking
over its sample of learning texts (PER_LANGUAGE a language, taken by the hash of the doc_id). A document gets the language
of least out-of-place distance: the sum over its TOP most frequent n-grams of the difference of the ranks, TOP for an
n-gram that the profile lacks.

Cases: null text or one without a letter gives `und` with score 0; so does a corpus without learning rows; a null doc_id is
neither learnt from nor held out; ties go to the language that sorts first; rows are kept one for one.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, plain, table

TOP, PER_LANGUAGE, BUCKETS, SHARP = 300, 900, 16, 30.0
_LETTER: list = []


def grams(text: str | None) -> np.ndarray:
    """Codes of the n-grams, repeats included: up to three code points of 21 bits each, spaces at word ends."""
    if not text:
        return np.empty(0, np.uint64)
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_LETTER[0][c], c, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    space = c == 32
    c = c[~(space & np.concatenate([[False], space[:-1]]))]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    letter = c != 32
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[letter], two, three[letter[1:-1]]])


def ranked(codes: np.ndarray, counts: np.ndarray | None = None, top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if counts is None:
        codes, counts = np.unique(codes, return_counts=True)
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    def __init__(self, of: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(of), top
        self.tables = []
        for k in self.names:
            codes = np.array(of[k], np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.names:
            return "und", 0.0
        mine = ranked(g, top=self.top)
        place, far = np.arange(len(mine)), []
        for codes, ranks in self.tables:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            far.append(np.where(codes[at] == mine, np.abs(ranks[at] - place), self.top).sum() / (len(mine) * self.top))
        d = np.array(far)
        p = np.exp(-SHARP * (d - d.min()))
        best = int(d.argmin())
        return self.names[best], float(p[best] / p.sum())


def _counted(batches):
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            codes, counts = np.unique(np.concatenate([grams(t) for k, t in zip(langs, texts) if k == lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", top: int = TOP, per_language: int = PER_LANGUAGE) -> Profiles:
    d = plain(docs, doc_id=doc_id, text=text, lang=lang)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id")) != 1)).select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BUCKETS)).alias("_b"))
    for by in (["lang", "_b"], ["lang"]):  # first the best of each bucket, so that the last window sees BUCKETS x per_language rows a language at most
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= per_language)
    some = some.select("doc_id").distinct()
    picked = d.join(F.broadcast(some), "doc_id", "left_semi").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = picked.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_k") <= top)
    of: dict[str, list] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["_k"])):  # top n-grams a language
        of.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(of, top)


def identify(docs: DataFrame, profiles: Profiles, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches):
        for b in batches:
            got = [profiles.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce(crc_mod(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
