"""From documents to mixed, packed token shards, stage by stage.

Each stage works on all that the one before kept, and is written and read again in
between. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.llm import decontam, mixing, neardup, quality, tokens
from casegate.llm.catalog import tokenizer_path
from casegate.llm.common import only, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is usual for their language."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return only(docs, judged.where("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that copies and links connect: the smallest doc_id,
    of its rows one."""
    joined = neardup.join(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash")).alias("first")
    return only(docs, joined.groupBy("class_key").agg(first).select("first.doc_id", "first.row_hash"), once=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words stands."""
    found = decontam.matches(decontam.build_index(docs), table(spark, sf_dir, "benchmark"), window=10)
    return only(docs, found.where("n_hit = 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, mixing.mix(docs, weights=(5, 2, 1), most=3))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, written to compressed shards and read back."""
    return tokens.round_trip(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("token output", pack),
]
# Perplexity and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents in order, each to what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
