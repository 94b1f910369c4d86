"""Operator 5, SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and maps to the vector of their bit counts. Changing one bit
changes one count by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance. Counts are
held in thermometer code (0, 1, 2 as 00, 01, 11), so that the Manhattan distance is the popcount of an exclusive or.
The range join for distance 3 runs on grids: the 32 coordinates fall into g groups, of which g - 3 at least agree
wholly if the distance is 3 or less; each choice of g - 3 groups is a grid whose cells are equal counts in these groups.
There are six groups (20 grids) up to some millions of fingerprints, and more, hence smaller cells, beyond that. Pairs within a cell pass the bound, then the exact Hamming distance.

Equal fingerprints are one node. Cells of more than LARGE fingerprints are compared in blocks of about BLOCK
fingerprints, each pair of blocks a task's unit, and give a star for each linked group, not its pairs.

Cases: null and empty texts have fingerprint zero; rows are kept one for one, repeated and null doc_ids included;
component_id is the least non-null doc_id of the component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, plain, skewed_lookup, table
from .components import components
from .shingles import shingle_hashes, words_of

SHINGLE, DISTANCE, GROUPS = 3, 3, 6
LARGE, BLOCK = 48, 1024
_PAIRS = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    h = shingle_hashes(words_of(text, lower=True), SHINGLE)
    if not len(h):
        return 0
    over = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        over += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > len(h)).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, key (a hash of the text) and fp of every row."""
    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    return d.mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def groups_for(n: int, distance: int = DISTANCE) -> int:
    """The least number of groups, GROUPS at least, whose cells hold a fingerprint or so: a segment's count has 1.5 bits."""
    fits = [g for g in range(GROUPS, 19) if 48 * (g - distance) / g >= math.log2(max(n, 1)) + 1]
    return fits[0] if fits else 18


def grid_masks(groups: int = GROUPS, distance: int = DISTANCE) -> list[int]:
    """A bit mask over the thermometer code for each choice of the groups that must agree, as signed longs."""
    of = [sum(3 << (2 * c) for c in range(32) if c % groups == g) for g in range(groups)]
    masks = [sum(x) for x in combinations(of, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def thermometer(fp):
    """Column: per-segment counts of a long, in thermometer code."""
    low = F.lit(_PAIRS)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _within(a, b, distance):
    return (F.bit_count(F.col(f"{a}.t").bitwiseXOR(F.col(f"{b}.t"))) <= distance) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance)


def _star(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Stars of the groups that are linked within these fingerprints."""
    fp = np.unique(pdf["fp"].to_numpy())
    x, n = fp.view(np.uint64), len(fp)
    label = np.arange(n)
    todo = np.ones(n, bool)
    for seed in range(n):
        if not todo[seed]:
            continue
        front = np.array([seed])
        todo[seed] = False
        while len(front):
            rest = np.flatnonzero(todo)
            near = np.zeros(len(rest), bool)
            for f in front:
                near |= np.bitwise_count(x[rest] ^ x[f]) <= distance
            front = rest[near]
            todo[front] = False
            label[front] = seed
    other = label != np.arange(n)
    return pd.DataFrame({"u": fp[label[other]], "v": fp[other]})


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Of distinct fingerprints (fp long): edges u, v that join just the fingerprints that links of at most this distance join."""
    masks = F.array(*[F.lit(m) for m in grid_masks(groups, distance)])
    t = fps.select("fp", thermometer(F.col("fp")).alias("t"))
    cells = t.select("fp", "t", F.posexplode(masks).alias("grid", "mask")).select("fp", "t", F.xxhash64("grid", F.col("t").bitwiseAND(F.col("mask"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(cells.join(sizes.hint("shuffle_merge"), "cell"), "cells")
    small, large = shared.where(F.col("n") <= LARGE), shared.where(F.col("n") > LARGE)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b.hint("shuffle_merge"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & _within("a", "b", distance)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    units = large.select("cell", "fp", blocks.alias("k"), F.pmod(F.xxhash64("fp", F.lit(1)), blocks).alias("b")).select("cell", "fp", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    units = units.select(F.xxhash64("cell", F.least("b", "j"), F.greatest("b", "j")).alias("unit"), "fp")
    stars = units.groupBy("unit").applyInPandas(lambda pdf: _star(pdf, distance), "u long, v long")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, key, fp, label (a fingerprint of the component) and component_id of every row."""
    fps = cut(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    joined = components(links(nodes.select("fp"), distance, groups_for(nodes.count(), distance)))
    label = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("label", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of_fp = label.join(least.hint("shuffle_merge"), "label").select("fp", "label", "component_id")
    return skewed_lookup(fps, of_fp, ["fp"], "inner")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, that of its least doc_id (null ones last), as it is."""
    found = near_duplicates(docs, distance=distance)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"))
    none = F.lit(-(1 << 63))
    best = cut(best.select(F.coalesce("r.doc_id", none).alias("_best_id"), F.col("r.key").alias("_best_key")), "best")
    # the row itself is one column, so that a caller's names meet none of these
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("_own_id"), F.xxhash64("text").alias("_own_key"))
    d = d.join(best.hint("shuffle_merge"), (F.col("_own_id") == F.col("_best_id")) & (F.col("_own_key") == F.col("_best_key")))
    w = Window.partitionBy("_own_id", "_own_key").orderBy(F.lit(1))
    return d.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("_row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
