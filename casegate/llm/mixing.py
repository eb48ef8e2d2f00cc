"""Mixing sources to target weights by subset-sum budget fitting.

Sources share all words by weight, none above a multiple of its own size. A
source's target is met by whole passes over its documents and a remaining budget,
which is fitted over the histogram of document sizes: every size gives its share,
a bounded-knapsack table closes what rounding leaves, and seeded hashes say which
documents of each size are taken once more. Work on documents is counting, joining
on (source, size) and ranking within small hash buckets; only histograms, whose
size is the number of different document sizes, meet in one task per source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casegate.llm.common import written

# Budget up to which the knapsack table is built; more is given out by size first.
TABLE_WORDS = 50_000
# Documents of one source and size are ranked within this many hash buckets.
BUCKETS = 256


def words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def row_hash() -> Column:
    """Hash of a document's id and text; with the id it names the row's content."""
    return F.xxhash64("doc_id", "text")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Target per source. ``sizes`` has (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. All words are
    shared by weight; a source's target stops at ``most`` times its size and the
    excess is shared again by weight until none is above. That is the level at which
    the sum of min(level * weight, most * size) is all words: sources are passed in
    order of the level at which they fill, and the first that does not fill sets it.
    Windows here run over one row per source. Without words all targets are 0.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sizes.withColumn("weight", F.get(shares, (F.row_number().over(order) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("filled", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("filled")) / F.col("open"))
        .withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("level", level).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"),
    )


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, table_words: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to
    ``budget`` as the table finds, never above it.

    Each size first gives its even share, then larger sizes fill in while the rest is
    beyond the table; the bounded-knapsack table of reachable sums takes what is left.
    Sizes are positive and distinct.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= table_words:
            break
        more = min(int(counts[i] - taken[i]), (rest - table_words) // int(sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    rest = min(rest, table_words + int(sizes.max()))
    # Reachable sums as bits of one number; per size, which sums it was first to reach.
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in np.argsort(-sizes, kind="stable"):
        left, one, size = int(counts[i] - taken[i]), 1, int(sizes[i])
        left = min(left, rest // size)
        while left > 0:
            part = min(one, left)
            wider = (reach | (reach << (part * size))) & mask
            steps.append((i, part, reach))
            reach, left, one = wider, left - part, one * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(sizes[i])
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and once-more counts for the histogram of one source."""
    sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), float(group["target"].iloc[0])
    passes = int(target // total)
    budget = int(round(target - passes * total))
    more = fit_counts(sizes, counts, budget)
    return pd.DataFrame({"source": group["source"], "size": sizes, "passes": passes, "more": more, "target": target, "source_size": total})


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document of ``docs`` (doc_id, text, source).

    One row per document: doc_id, row_hash, source, size, source_size, target, copies.
    A null text has size 0; documents of size 0 are never taken. Repeated rows are
    documents of their own. Documents of one source and size are taken in the order
    of a seeded hash of id and text, so reruns agree. No document is taken more than
    ``most`` times.
    """
    slim = written(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            row_hash().alias("row_hash"),
            F.col("source").alias("source"),
            words(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("draw"),
        ),
        "sizes",
    )
    histogram = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = written(targets(per_source, weights, most), "targets")
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    takes = written(
        histogram.alias("h")
        .where("size > 0")
        .join(aims.alias("t"), same)
        .select("h.source", "size", "n", "target")
        .groupBy("source")
        .applyInPandas(_fit, "source string, size bigint, passes int, more bigint, target double, source_size bigint"),
        "takes",
    )
    # How many of each hash bucket go once more: whole buckets by running count, then ranks in the last.
    bucketed = slim.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    running = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        bucketed.groupBy("source", "size", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .alias("b")
        .join(takes.alias("k"), F.col("b.source").eqNullSafe(F.col("k.source")) & (F.col("b.size") == F.col("k.size")))
        .select("b.source", "b.size", "bucket", "passes", (F.col("more") - F.col("before")).alias("left"))
    )
    rank = F.row_number().over(W.partitionBy("d.source", "d.size", "d.bucket").orderBy("draw"))
    chosen = (
        bucketed.alias("d")
        .join(
            cuts.alias("c"),
            F.col("d.source").eqNullSafe(F.col("c.source"))
            & (F.col("d.size") == F.col("c.size"))
            & (F.col("d.bucket") == F.col("c.bucket")),
            "left",
        )
        .select(
            "doc_id",
            "row_hash",
            F.col("d.source").alias("source"),
            F.col("d.size").alias("size"),
            F.coalesce(F.col("passes") + (rank <= F.col("left")).cast("int"), F.lit(0)).alias("copies"),
        )
    )
    return (
        chosen.alias("d")
        .join(aims.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "row_hash", F.col("d.source").alias("source"), "size", "source_size", "target", "copies")
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as ``mixed`` takes them, same columns.
    Rows of equal id, text and source are taken equally often, but for one copy that the
    first of them by a running number have more. They are numbered and joined by the
    same key, so texts are shuffled once."""
    key = {"__id": F.coalesce("doc_id", F.lit(0)), "__hash": row_hash(), "__from": F.xxhash64("source")}
    here = docs.withColumns(key).withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("__id")))
    there = (
        mixed.select(*[(F.col("row_hash") if name == "__hash" else column).alias(name) for name, column in key.items()], "copies")
        .groupBy(*key)
        .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
        .where("__copies > 0")
    )
    return (
        here.join(there, list(key))
        .withColumn("__copies", F.expr("__copies div __rows + if(__n <= __copies % __rows, 1, 0)"))
        .where("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
