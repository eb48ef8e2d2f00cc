"""What several operators share: written tables, text blocks, word hashes."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from casegate.session import workspace

T = TypeVar("T")

# Characters of text a task holds as words at once.
BLOCK_CHARS = 3_000_000


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{workspace(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    path = folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries. It does when the driver
    collects garbage, and a driver with room left would rarely come to that."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """Fold of a document: crc32 of its id as text. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def blocks(texts: Sequence[str], chars: int = BLOCK_CHARS) -> Iterator[slice]:
    """Cut rows into runs of about ``chars`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def word_codes(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Code of each word and the distinct words, in order of first use."""
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.factorize(flat)


def word_hashes(words: list) -> np.ndarray:
    """A stable 64-bit hash of each word, computed once per distinct word."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes, distinct = word_codes(words)
    return pd.util.hash_array(distinct, categorize=False)[codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit numbers (fixed values of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def offsets(counts: np.ndarray) -> np.ndarray:
    """Start of each run, and the end of the last."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def per_process(name: str, build: Callable[[], T]) -> T:
    """What ``build`` makes, kept as long as the worker process lives."""
    kept = sys.modules.setdefault("_casegate_kept", types.ModuleType("_casegate_kept")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


def only(docs: DataFrame, chosen: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id and text stand in ``chosen`` (doc_id, row_hash of the
    text), with the columns of ``docs``; rows that repeat stay ``once`` or each."""
    nobody = F.lit(-(1 << 63))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), nobody), "__hash": F.xxhash64("text")})
    keys = chosen.select(F.coalesce("doc_id", nobody).alias("__id"), F.col("row_hash").alias("__hash"))
    kept = keyed.join(keys, ["__id", "__hash"], "left_semi")
    if once:
        kept = kept.withColumn("__n", F.row_number().over(W.partitionBy("__id", "__hash").orderBy("__id"))).where("__n = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
