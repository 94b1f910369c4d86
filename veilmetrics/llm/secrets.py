"""Operator 1, secret scans by corpus-wide ownership frequency.

Every whole text is scanned for credential-shaped spans. Candidates are hashed, and the hashes are counted over
distinct repositories and owners of the whole corpus: what many owners share is a copied example, what one owner
alone holds and looks random is a live-looking credential. Unlabelled random strings become spans of kind `live`
only if the corpus says that they are owner-specific.

Cases: null or empty text has no spans; null owner or repository counts as the empty name; rows are kept one for one,
repeated doc_ids and null doc_ids included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain, skewed_lookup, table

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same spans as AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
SOLID = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]+")
MIN_BITS, SOLID_BITS = 3.5, 3.0
MAX_OWNERS = 1

SCHEMA = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:int,end:int,digest:string>>"


def looks_random(s: str) -> bool:
    """Twenty characters or more of upper, lower and digits with MIN_BITS bits of entropy a character, or letters and at
    least three digits without any mark, of either case alone too, with SOLID_BITS; the ownership counts decide."""
    n, digits = len(s), sum(c.isdigit() for c in s)
    mixed = n >= 20 and digits and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s)
    solid = 3 <= digits <= n - 3 and SOLID.fullmatch(s)
    if not (mixed or solid):
        return False
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= (SOLID_BITS if solid else MIN_BITS)


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) by start, then kind."""
    base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    loose = [m for m in LOOSE.finditer(text) if looks_random(m[0])]
    base += [(m.start(), 3, m.end(), m[0]) for m in loose if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
    return sorted(base)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _scan_batches(batches):
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            rows.append(scan(text) if text else [])
        base = [[x for x in r if x[1] < 3] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id").cast(pa.int64()), b.column("owner"), b.column("repo"),
                *(pa.array([sum(x[1] == k for x in r) for r in base], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(written(r).encode()).hexdigest() for r in base]),
                pa.array(
                    [[{"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in r] for r in rows],
                    pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())])),
                ),
            ],
            names=["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """Of (digest, owner, repo) rows: digest, n_seen, n_repos, n_owners. Each step combines before its shuffle."""
    by_repo = found.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_seen"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo="lang", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: the base counts and digest, `found` spans with their corpus verdicts, and `spans`.

    A repository is named by its owner and the `repo` column together.
    """
    d = plain(docs, doc_id=doc_id, text=text, owner=owner, repo=repo).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"))
    scanned = cut(d.mapInArrow(_scan_batches, SCHEMA).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    each = scanned.where(F.size("found") > 0).select("_row", "owner", "repo", F.explode("found").alias("s")).select("_row", "owner", "repo", "s.*")
    judged = skewed_lookup(each, ownership(each.select("digest", "owner", "repo")), ["digest"], "inner")
    specific = F.col("n_owners") <= max_owners
    judged = judged.where((F.col("kind") < 3) | specific).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_seen", "n_repos", "n_owners"))).alias("judged"),
        F.sum(F.when(specific, 1).otherwise(0)).alias("n_owner_specific"),
        F.sum(F.when(specific, 0).otherwise(1)).alias("n_widely_copied"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("judged", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return scanned.join(judged, "_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"),
        F.coalesce("n_owner_specific", zero).alias("n_owner_specific"), F.coalesce("n_widely_copied", zero).alias("n_widely_copied"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
