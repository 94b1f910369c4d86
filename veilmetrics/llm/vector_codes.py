"""Operator 12, vector codes with annular norm pruning.

Vectors become integers (floor(256 * x)) and are cut into equal parts; every part is replaced by the index of its nearest
codebook entry. A part's entries are sorted by norm. Since |norm(x) - norm(e)| is a lower bound of the distance of x and e,
only entries whose norm differs from that of x by the best distance so far, or less, can be as near: both ends of that
annulus are found by binary search, ends included, and the entries in it are evaluated exactly, in integers. The first
best distance comes from the two entries on either side of the norm of x.

A codebook (parts x entries x width integers, bounded by its parameters) goes to the tasks with the function. A round's
sums are added up within each task, then by Spark; the driver sees one row for each component of the codebook.

Cases: a vector that is null, holds a null or non-finite component, or has not the kept vectors' length (that of the least
vec_id whose length is a positive multiple of the parts) is dropped. Rows are kept one for one, repeated and null vec_ids
included; a null vec_id comes last among the first entries, equal ones by vector. With fewer rows than entries the
codebook is that small. Sums are exact at any magnitude; an error beyond a long is null. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BROADCAST_LABELS = 100_000
_LIMB = 10**18


def floors(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a matrix of doubles: int64 where that holds them, else Python integers."""
    x = np.floor(rows * float(SCALE))
    if not x.size or np.abs(x).max() < 2.0**53:
        return x.astype(np.int64)
    return np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


def _largest(x: np.ndarray) -> int:
    return max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point (a row of integers): the index of its nearest entry, ties to the lower, and their squared distance."""
    n, k = len(points), len(entries)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = points.shape[1] * (2 * max(_largest(points), _largest(entries)) + 1) ** 2 * (k + 1) >= 2**62
    kind = object if wide else np.int64
    points, entries = points.astype(kind), entries.astype(kind)
    norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms, ranked = norms[order], entries[order]
    own = np.sqrt((points * points).sum(1).astype(np.float64))

    def keys(rows, at):  # orders by distance, then by index
        gap = points[rows] - ranked[at]
        return (gap * gap).sum(1) * k + order[at]

    everyone = np.arange(n)
    above = np.minimum(np.searchsorted(norms, own), k - 1)
    best = np.minimum(keys(everyone, above), keys(everyone, np.maximum(above - 1, 0)))
    radius = np.sqrt((best // k).astype(np.float64))
    slack = 1e-9 * (own + radius + norms[-1] + 1)  # the norms are rounded; the annulus must not lose an entry for that
    lo = np.searchsorted(norms, own - radius - slack, "left")
    size = np.searchsorted(norms, own + radius + slack, "right") - lo
    first = np.cumsum(size) - size
    rows = np.repeat(everyone, size)
    found = np.minimum.reduceat(keys(rows, np.arange(len(rows)) - np.repeat(first - lo, size)), first)
    return (found % k).astype(np.int64), found // k


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _sums(books: np.ndarray, dim: int):
    """Task function: per part, entry and component the number and the sum (in two limbs) of its points."""
    parts, k, width = books.shape

    def run(batches):
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for b in batches:
            x = floors(_matrix(b.column("embedding"), dim))
            small = x.dtype != object and _largest(x) * (len(x) + 1) < 2**62
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                code, _ = nearest(mine, books[p])
                n[p] += np.bincount(code, minlength=k)
                add = np.zeros((k, width), np.int64 if small else object)
                np.add.at(add, code, mine)
                total[p] += add.astype(object)
        at = [(p, e, c) for p, e in np.argwhere(n).tolist() for c in range(width)]
        sums = [int(total[x]) for x in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32()), pa.array([x[2] for x in at], pa.int32()),
             pa.array([int(n[x[:2]]) for x in at], pa.int64()), pa.array([Decimal(s // _LIMB) for s in sums], pa.decimal128(38, 0)), pa.array([s % _LIMB for s in sums], pa.int64())],
            names=["part", "entry", "at", "n", "high", "low"])

    return run


def _codes(books: np.ndarray, dim: int):
    """Task function: vec_id, label, code and error of each row."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            x = floors(_matrix(b.column("embedding"), dim))
            index, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), object)
            for p in range(parts):
                index[:, p], d = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += d.astype(object)
            code = [r.tobytes().hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame, vec_id="vec_id", embedding="embedding", label="label") -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is whole and finite, as FLOAT has it: below 2^128."""
    d = plain(vectors, vec_id=vec_id, label=label, embedding=embedding).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return d.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**128)))


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x width integers) after so many rounds; None of no vectors."""
    fits = kept.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    head = fits.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("d")).head(1)
    if not head:
        return None
    dim = head[0]["d"]
    rows = kept.where(F.size("embedding") == dim).select("vec_id", "embedding")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # `entries` rows
    books = floors(np.array([r["embedding"] for r in first], np.float64)).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).astype(object)
    for _ in range(rounds):
        task = _sums(books, dim)
        sums = rows.select("embedding").mapInArrow(task, "part int, entry int, at int, n long, high decimal(38,0), low long")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
        books = books.copy()
        for r in sums.collect():  # a row for each component of the codebook at most
            books[r["part"], r["entry"], r["at"]] = (int(r["high"]) * _LIMB + int(r["low"])) // r["n"]
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each row of the codebooks' length."""
    if books.shape[1] > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    dim = books.shape[0] * books.shape[2]
    rows = kept.where(F.size("embedding") == dim)
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return rows.mapInArrow(_codes(books, dim), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over equal labels, nulls together."""
    none, value = F.col("label").isNull(), F.col("label").cast("string")
    d = cut(coded, "codes").withColumns({"_none": none, "_label": F.coalesce(value, F.lit(""))})
    sums = cut(d.groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")), "label-errors")
    sums = sums.select("_none", "_label", F.expr("try_cast(_sum AS long)").alias("label_error"))
    small = sums.count() <= BROADCAST_LABELS  # else both sides are shuffled by the join, which can split a hot label
    return d.join(F.broadcast(sums) if small else sums.hint("shuffle_merge"), ["_none", "_label"]).drop("_none", "_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_vectors(table(spark, sf_dir, "embeddings"))
    books = learn(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    return with_label_error(encode(kept, books)).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """Nearest entries of all parts under codebook b{i}, as a{i}."""
    return f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, part, x, m % 64 AS entry, m // 64 AS d FROM (
    SELECT p.r, p.vec_id, p.part, any_value(p.x) AS x,
      min(list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT * 64 + b.entry) AS m
    FROM p JOIN b{i} b ON p.part = b.part GROUP BY p.r, p.vec_id, p.part))"""


def _update(i: int) -> str:
    """Codebook b{i+1}: floors of the means under a{i}."""
    return f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY c) AS x FROM (
      SELECT part, entry, c, CAST(floor(sum(x[c]) / count(*)) AS BIGINT) AS v FROM a{i}, range(1, (SELECT max(len(x)) + 1 FROM p)) t(c) GROUP BY part, entry, c)
    GROUP BY part, entry) u ON b.part = u.part AND b.entry = u.entry)"""


ORACLE_SQL = {
    "op12_vector_codes": f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, v[len(v) // 16 * part + 1 : len(v) // 16 * (part + 1)] AS x FROM k, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
{_round(0)}, {_update(0)}, {_round(1)}, {_update(1)}, {_round(2)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
e AS (SELECT r, vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r, vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e JOIN k USING (r) GROUP BY label)
SELECT e.vec_id, e.code, e.error, l.label_error, h.codebooks_sha256
FROM e JOIN k ON e.r = k.r JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"""
}
