"""A corpus from raw documents to packed sequences, in five stages.

Quality rules, near-duplicates, personal data, mixing, packing: each stage
takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
All but the last return the columns of documents. Between stages the rows are
written as Parquet in the checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import line_quality, mixing, near_dedup, packing, sanitise
from inkwell.llm.common import fingerprints, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that recur across their host."""
    return line_quality.cleaned_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8.
    Documents without an id stay; rows that repeat an id and text go but one.
    Where an id has several texts, each is a document of its own; of a group
    the smallest id stays, and of its texts the smallest fingerprints."""
    key = ["_id", "_fp1", "_fp2"]
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), "text", *fingerprints())
    texts = F.struct("_fp1", "_fp2")
    clash = rows.filter("_id is not null").groupBy("_id").agg(F.min(texts).alias("_first"), F.max(texts).alias("_last"))
    clash = stored(clash.filter("_first <> _last").select("_id", "_first"), "clash")
    # the node of a text is its id, or a hash where another text has taken the id
    node = F.when(F.col("_first").isNull() | (F.col("_first") == texts), F.col("_id")).otherwise(F.xxhash64(*key))
    rows = rows.join(clash, "_id", "left").withColumn("_node", node)
    group = near_dedup.near_duplicates(rows, width=5, percent=80, id_col="_node").filter("doc_id is not null")
    if clash.isEmpty():
        kept = group.filter("kept").select(F.col("doc_id").alias("_node")).distinct()
    else:
        group = group.select(F.col("doc_id").alias("_node"), "component_id").distinct()
        first = F.min_by("_node", F.struct(*key)).alias("_node")
        kept = rows.select("_node", *key).join(group, "_node").groupBy("component_id").agg(first).select("_node")
    one = rows.filter("_id is not null").dropDuplicates(["_node"])
    return one.join(kept, "_node", "left_semi").select("_doc.*").union(docs.filter("doc_id is null"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced."""
    return sanitise.sanitised_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
