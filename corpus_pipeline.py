"""Corpus pipeline: quality classifier, SimHash near-duplicates, decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir). All but the last return rows of docs as they are, with just their columns, whatever
these are called; the last returns the digest of the token store that it has written and read back, in the order of the mix.

Cases, of every stage: an empty table gives an empty result (the last one an empty store); rows with nulls in any column,
empty and very long texts and repeated rows are rows like others, unless the stage says more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmetrics.llm import decontamination, mixing, quality, simhash, token_store
from veilmetrics.llm.common import cut, new_dir, ready, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more.

    Cases: a null or empty text is scored by its statistics like any other and goes if it scores lower; a null doc_id has no
    label and is scored; without labels every document stays, with labels of one kind alone all stay or go by that kind;
    repeated rows stay or go together.
    """
    ready(spark)
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the least doc_id.

    Cases: null and empty texts have one fingerprint and are one group with what it links; null doc_ids come last; of rows
    equal in doc_id and text one stays; of texts that share the least doc_id, one.
    """
    ready(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Cases: null and empty texts hold no item and stay; rows of a null doc_id are told apart by their texts; repeated rows
    stay or go together; an empty benchmark removes nothing.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their files in the order of the Pfair schedule.

    Cases: a null source is a source of its own; null and repeated doc_ids have places of their own; texts are not looked at.
    """
    ready(spark)
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store in the order of the Pfair schedule, which the same rows give again.

    Cases: a null or empty text is its end id alone; repeated rows are documents of their own, whose chunks are stored once.
    """
    ready(spark)
    path = new_dir(spark, "store")
    ordered = mixing.schedule(docs.select("doc_id", "text", "source")).withColumn("position", F.col("_mix.position"))
    token_store.write_store(ordered, path, order_by="position")
    return token_store.read_back(spark, path).select("doc_id", "place", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_store", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
