"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegate.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of ``edges`` (a bigint, b bigint): the smallest node that each
    node is connected with. Nodes without an edge are not in the result.

    Large-star and small-star rounds in turn: every node hands its smallest neighbour
    to the larger ones, then to the smaller ones, until all edges lead to the smallest
    node of their component. Smallest neighbours are minima that combine before the
    shuffle; each round writes its edges, at most as many as before.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            ).distinct()
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("low", "a").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
