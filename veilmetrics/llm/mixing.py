"""Operator 8, mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks. With target weight w, its k-th block is released at slot floor(k / w) and is due
by slot ceil((k + 1) / w); in each slot the released block with the earliest deadline is sent, so that as long as all
sources last, after t slots each has sent w * t blocks, give or take less than one. When a source is used up, a new phase
begins, in which the others share its weight: every document is sent once, none is dropped or repeated.

The driver sees a count for each source, and schedules BLOCKS blocks and one a source at most; documents find their block
by a distributed rank. Within a source the order is by bucket, then by the hash of the doc_id.

A source has a bucket for each LEAST_BUCKET of its rows, or each BUCKETS-th part of all rows if that is more, so that the
rank of a row is found among few rows however large the source is. An id of more rows than that is spread over all of its
source's buckets, row by row. How many buckets a source has, and at which rank each begins, are small tables.

Default weights: each source's share to the power ALPHA, normalised; given ones must name every source (a null source as
None) and be positive. Cases: null source is a source of its own; repeated
rows keep places of their own; an empty table gives an empty result; other columns ride along, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

LEAST_BUCKET, BUCKETS, BLOCKS, LEAST_BLOCK, ALPHA = 1_000, 500_000, 32_768, 16, 0.5


def _whole(weights: dict[str, Fraction]) -> dict[str, int]:
    """Weights as integers: exact if a common denominator is at hand, else to twelve places of the largest."""
    lcm = math.lcm(*{w.denominator for w in list(weights.values())[:1000]}) if weights else 1
    if lcm < 1 << 64 and all(lcm % w.denominator == 0 for w in weights.values()):
        return {s: int(w * lcm) for s, w in weights.items()}
    most = max(weights.values())
    return {s: max(1, int(w * 10**12 / most)) for s, w in weights.items()}


def pfair(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, phase) for each slot.

    blocks: how many each source has. weights: positive; they are normalised over the sources that have blocks left.
    Deadlines are compared before they are rounded up, ties by source. A phase begins with no heap to be built: sources
    that have not sent in it wait in order of weight, so that the time grows with slots and sources, not with their product.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    w = _whole({s: Fraction(weights[s]) for s in left})
    order = sorted(left, key=lambda s: (-w[s], s))
    place, after = {s: i for i, s in enumerate(order)}, list(range(len(order) + 1))

    def alive(i):  # the first source from the i-th on that has blocks left
        while after[i] != i:
            after[i] = i = after[after[i]]
        return i

    out: list = []
    sent, total, phase = dict.fromkeys(left, 0), sum(w.values()), 0
    while left:
        t0, head = len(out), alive(0)
        future: list = []
        ready: list = []

        def due(s, k, total=total):
            return ((k + 1) * total << 40) // w[s]

        while True:
            t = len(out) - t0
            while future and future[0][0] <= t:
                release, s, k = heapq.heappop(future)
                heapq.heappush(ready, (due(s, k), s, k, release))
            if head < len(order) and (not ready or (due(order[head], 0), order[head]) < ready[0][:2]):
                s, k, release, head = order[head], 0, 0, alive(head + 1)
            elif ready:
                _, s, k, release = heapq.heappop(ready)
            else:  # cannot be while the shares add up to one
                raise AssertionError("no block is released")
            out.append((s, sent[s], t0 + release, t0 - (-(k + 1) * total // w[s]), phase))
            sent[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                after[place[s]] = place[s] + 1
                total -= w[s]
                break
            heapq.heappush(future, ((k + 1) * total // w[s], s, k + 1))
        phase += 1
    return out


def default_weights(counts: dict[str, int], alpha: float = ALPHA) -> dict[str, Fraction]:
    total = sum(c**alpha for c in counts.values()) or 1
    return {s: Fraction(max(1, round(c**alpha / total * 10**6)), 10**6) for s, c in counts.items()}


def _scheduled(docs: DataFrame, doc_id: str, source: str, weights: dict[str | None, float] | None) -> DataFrame:
    """_r (the row) and _mix of every row of docs."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_ms")  # null: the empty name
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"), name, F.col(f"`{doc_id}`").alias("_id"), F.monotonically_increasing_id().alias("_nth"))
    size = {r["_ms"]: r["n"] for r in d.groupBy("_ms").agg(F.count("*").alias("n")).collect()}  # a row for each source
    if weights is not None and (none := sorted(s[1:] if s else "null" for s in size if not weights.get(s[1:] if s else None, 0) > 0)):
        raise ValueError(f"no positive weight for {none}")
    rows, total = [], sum(size.values())
    most, block = max(LEAST_BUCKET, -(-total // BUCKETS)), max(LEAST_BLOCK, -(-total // BLOCKS))
    given = default_weights(size) if weights is None else {s: Fraction(weights[s[1:] if s else None]).limit_denominator(10**6) for s in size}
    at = 0
    for s, k, release, deadline, phase in pfair({s: -(-n // block) for s, n in size.items()}, given):
        rows.append((s, k, at, release, deadline, phase))
        at += min(block, size[s] - k * block)
    plan = spark.createDataFrame(rows, "_ms string, _mb long, _first long, release long, deadline long, phase int")
    buckets = spark.createDataFrame([(s, -(-n // most)) for s, n in size.items()], "_ms string, _buckets int")
    # an id of more rows than a bucket should have is spread by row; there are BUCKETS such ids at most
    often = cut(d.groupBy("_ms", "_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("_ms").alias("_os"), F.col("_id").alias("_oi"), F.lit(True).alias("_often")), "often")
    d = d.join(F.broadcast(buckets), "_ms").join(F.broadcast(often), (F.col("_ms") == F.col("_os")) & F.col("_id").eqNullSafe(F.col("_oi")), "left")
    h = F.when(F.col("_often"), F.xxhash64("_nth")).otherwise(F.xxhash64("_id"))
    d = d.select("_r", "_ms", "_id", F.pmod(h, F.col("_buckets")).cast("int").alias("_bucket"))
    counts = cut(d.groupBy("_ms", "_bucket").agg(F.count("*").alias("n")), "buckets")  # BUCKETS rows and one a source at most
    before = Window.partitionBy("_ms").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_ms", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    w = Window.partitionBy("_ms", "_bucket").orderBy(F.xxhash64("_id", F.lit(7)), F.col("_id").asc_nulls_first())
    d = d.withColumn("_rank", F.row_number().over(w) - 1).join(F.broadcast(starts), ["_ms", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    d = d.withColumn("_mb", F.floor(F.col("_rank") / block)).join(F.broadcast(plan), ["_ms", "_mb"])
    position = (F.col("_first") + F.col("_rank") - F.col("_mb") * block).alias("position")
    return d.select("_r", F.struct(F.when(F.col("_ms") != "", F.substr(F.col("_ms"), F.lit(2))).alias("source"), F.col("_mb").alias("block"), "release", "deadline", "phase", position).alias("_mix"))


def schedule(docs: DataFrame, doc_id="doc_id", source="source", weights: dict[str | None, float] | None = None, name: str = "_mix") -> DataFrame:
    """The rows of docs with a column `name`: source, block, release, deadline, phase and position, gapless from 0."""
    if name in docs.columns:
        raise ValueError(f"docs have a column {name}; give another name")
    return _scheduled(docs, doc_id, source, weights).select("_r.*", F.col("_mix").alias(name))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs in the order of the schedule: partitions of ascending position, sorted within."""
    n, total = partitions(docs.sparkSession), max(1, docs.count())
    d = _scheduled(docs, "doc_id", "source", weights)
    part = F.least(F.lit(n - 1), F.floor(F.col("_mix.position") * n / total)).cast("int")
    return d.withColumn("_part", part).repartitionById(n, "_part").sortWithinPartitions("_mix.position").select("_r.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schedule(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source"))
    return d.select("doc_id", F.col("_mix.source").alias("source"), "_mix.block", "_mix.release", "_mix.deadline", "_mix.phase", "_mix.position")
