"""Report tables: JSON source with a fixed schema, partitioned sinks, batch manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
REDACTIONS = f"input string, redactions array<struct<page_index:int,bbox:{RECT},kind:string,score:double,meta:map<string,string>,underlying_text:array<struct<page_index:int,bbox:{RECT},text:string>>>>, count int, page_counts map<string,int>, diagnostics array<string>"


def read_redactions(spark: SparkSession, path: str) -> DataFrame:
    """One row per box of each report; absent fields are null."""
    r = spark.read.schema(REDACTIONS).option("multiLine", "true").json(path)
    return r.select("input", F.posexplode("redactions").alias("idx", "r")).select("input", "idx", "r.page_index", "r.bbox", "r.kind", "r.score")


def write_reports(df: DataFrame, path: str, by: str = "doc_id", fmt: str = "json") -> None:
    """One folder for each value of `by`; rows are brought together first, so that a folder has few files."""
    df.repartition(by).write.partitionBy(by).format(fmt).save(path)
