"""Operator 9, document fingerprints as threshold-scaled sketches.

A sketch holds every distinct hash of a five-word shingle (of the whole text, if it is shorter) below a fixed fraction,
1 / SCALE, of the hash range; and of a text with few of them the FLOOR least hashes, so that texts of up to FLOOR shingles
are held whole and every text with words has hashes. The same threshold holds for all texts: sketches of parts merge by
union, cut by the same rule, to the sketch of the whole.

Each sketch knows all hashes of its text up to some bound (the threshold, or its largest hash if that is more, or all). Two
sketches are compared up to the lower of their bounds, and the share of one's hashes there that the other has estimates
how much of the first text the second contains, however unequal their lengths. It is exact where both texts have fewer than
FLOOR shingles; else its standard error is sqrt(c (1 - c) / m) at a containment c with m hashes up to the bound: m is FLOOR
or more for texts of like length (.044 at worst), and a SCALE-th of the shorter text's shingles if only the other one is
long. A short text none of whose hashes lies below a long one's bound has the likeness 0.

A fingerprint is the sorted hashes, 16 hex digits each, joined without a separator. Likeness is the containment of the
text with fewer hashes up to the bound in the other; only texts without words have empty sketches: two of them are alike
(1.0), one and another text are not (0.0).

Cases: null text is the empty text; documents are ordered by descending doc_id, nulls last, then by the hash of the
text; the next of the last is the first, and of an only document is itself; rows are kept one for one; an id that very
many rows share is spread by the hash of the text (rows equal in both stay in one task, which reads them as a stream); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, plain, table
from .shingles import window_hashes, word_hashes, words_of

SHINGLE, SCALE, FLOOR = 5, 4, 128


def _cut(h: np.ndarray, scale: int, floor: int) -> np.ndarray:
    """Of sorted distinct hashes those below the threshold, or the floor least."""
    return h if scale <= 1 else h[: max(int(np.searchsorted(h, np.uint64(2**64 // scale))), floor)]


def sketch(text: str | None, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The retained hashes, sorted and distinct."""
    w = word_hashes(words_of(text))
    h = window_hashes(w, min(SHINGLE, len(w))) if len(w) else w
    return _cut(np.unique(h), scale, floor)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of two texts' shingles together, from their sketches."""
    return _cut(np.union1d(a, b), scale, floor)


def bound(s: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> int:
    """The hash up to which a sketch has all hashes of its text."""
    if scale <= 1 or len(s) < floor:
        return 2**64 - 1
    return max(2**64 // scale - 1, int(s[-1]))


def _common(a: np.ndarray, b: np.ndarray, scale: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.uint64(min(bound(a, scale, floor), bound(b, scale, floor)))
    return a[: np.searchsorted(a, t, "right")], b[: np.searchsorted(b, t, "right")]


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float:
    """The share of a's shingles that b has, by the hashes that both sketches would hold."""
    if not len(a):
        return float(not len(b))
    a, b = _common(a, b, scale, floor)
    return float(np.isin(a, b, assume_unique=True).mean()) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = _common(a, b, scale, floor)
    if not len(x) or not len(y):
        return 0.0
    return containment(x, y, 1) if len(x) <= len(y) else containment(y, x, 1)


def written(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches):
    """Rows come by bucket and order; each is paired with the next of its bucket. The last of a bucket is the next bucket's first, sent along only to be a neighbour."""

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held, rows, chars = None, [], 0
    for b in batches:
        for bucket, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            text = text or ""
            now = (bucket, doc_id, text, sketch(text), guest)
            if held is not None and held[0] == bucket and not held[4]:
                new = edited(held[2], text)
                s = sketch(new)
                rows.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(held[3]), written(s), likeness(held[3], s), likeness(held[3], now[3])))
                chars += len(new)
            held = now
            if chars > 4_000_000:
                yield out(rows)
                rows, chars = [], 0
    yield out(rows)


def _above(cuts: list[int], x):
    """Column: how many of the descending cuts are above x. Every k-th cut is looked through, then the k after the last of them that is above."""
    if not cuts:
        return F.lit(0)
    k = max(1, math.isqrt(len(cuts)))
    longs = lambda c: F.array(*map(F.lit, c)).cast("array<bigint>")
    coarse = F.size(F.filter(longs(cuts[::k]), lambda c: c > x))
    fine = F.size(F.filter(F.slice(longs(cuts), F.greatest((coarse - 1) * k + 1, F.lit(1)), F.lit(k)), lambda c: c > x))
    return F.when(coarse > 0, (coarse - 1) * k + fine).otherwise(F.lit(0))


def with_next(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """SCHEMA of every row.

    The texts are shuffled once, by ranges of the doc_id; the first document of a range is sent to the range before it too.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = d.count()
    # an id of more rows than a range should have is a range of its own, cut by the hash of the text; there are n such ids at most
    often = {r["doc_id"]: -(-r["n"] * n // total) for r in d.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") * n > total).collect()} if n > 1 and total else {}
    cuts = d.select("doc_id").where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(x) for x in cuts} | {x + i for x in often if x is not None for i in (0, 1) if x + i < 1 << 63}, reverse=True)
    h = F.coalesce(F.xxhash64("text"), F.lit(0))
    share = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 43)  # the hash's place in its order, in 2^21 steps
    # bucket 0 has the largest ids; nulls come last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_above(cuts, F.col("doc_id"))).cast("long")
    for x, parts in often.items():  # parts of that id, and room for them among the buckets after it
        own = F.col("doc_id").eqNullSafe(F.lit(x))
        bucket = bucket + F.when(own, F.shiftright(share * parts, 21)).otherwise(F.when(F.coalesce(F.col("doc_id") < F.lit(x), F.lit(x is not None)), F.lit(parts - 1)).otherwise(0))
    d = d.withColumn("bucket", bucket.cast("int"))
    order = F.struct(F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit("10000000000000000000").cast("decimal(20,0)")).alias("o"), h.alias("h"))
    firsts = {r["bucket"]: r["o"] for r in d.groupBy("bucket").agg(F.min(order).alias("o")).collect()}  # a row for each bucket
    used = sorted(firsts)
    guests = [(firsts[b]["o"], firsts[b]["h"], used[i - 1]) for i, b in enumerate(used)]
    host = spark.createDataFrame(guests or [(Decimal(0), 0, -1)], "_o decimal(20,0), _h long, host int")
    d = d.select("doc_id", "text", "bucket", order.alias("_x"))
    sent = d.join(F.broadcast(host), (F.col("_x.o") == F.col("_o")) & (F.col("_x.h") == F.col("_h")), "left")
    rows = sent.select("doc_id", "text", "_x", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))).alias("to"))
    rows = rows.select("doc_id", "text", "_x", "to.bucket", "to.guest").repartitionById(n, F.pmod("bucket", F.lit(n)))
    return rows.sortWithinPartitions("bucket", "guest", "_x").select("bucket", "guest", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
