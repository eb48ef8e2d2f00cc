"""Small tables with awkward rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Columns that clash with names the operators use themselves.
EXTRA = "key string, size int, n bigint, shard int, copies int, `first` string, __id int, word string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def words(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def rows() -> list[tuple]:
    base = words(60)
    near = [*base[:30], "changed", *base[31:]]
    long = words(30_000, seed=4)
    texts = [
        (1, " ".join(base), "en", "b"),
        (2, " ".join(base), "en", "b"),
        (3, " ".join(near), "en", "a"),
        (4, "  Odd\t\tspaces \n\n and  été | 12,5%%% ", "fr", "a"),
        (5, "", "fr", None),
        (6, None, "en", "a"),
        (7, " ".join(long), "en", "c"),
        (8, "short", None, "c"),
        (8, "short", None, "c"),
        (None, "no id here at all", "en", "b"),
        (None, None, None, None),
        (9, "!!! ... ???", "de", "b"),
        (10, " ".join(words(40, seed=9)) + " " + " ".join(base[5:25]), "de", "d"),
    ]
    return [(i, t, lang, s, len(t or ""), "k", 1, 2, 3, 4, "f", 5, "w") for i, t, lang, s in texts]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
