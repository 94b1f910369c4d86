"""What the operators of this subpackage share: reading, shared storage, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, and bounds the texts that a worker holds at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    have = f"{env.get('PYTHONPATH', '')}:{os.environ.get('PYTHONPATH', '')}".split(":")
    if _ROOT not in have:
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="veilmetrics-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(docs: DataFrame, **cols: str) -> DataFrame:
    """Only the columns that an operator uses, under its own names; others, whatever they are called, stay out."""
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def crc_mod(doc_id, n: int = 3):
    """crc32(doc_id as text) mod n, the fold rule of the classifiers."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def skewed_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", name: str = "lookup") -> DataFrame:
    """Equi-join of many rows with at most one row a key.

    right is written first, so that the join shuffles both sides itself: only then can adaptive execution split a hot key.
    """
    return left.join(cut(right, name).hint("shuffle_merge"), keys, how)
