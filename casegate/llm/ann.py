"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised on its own; a cell is a
pair of centroids. A query walks the pairs by summed distance with a heap until the
cells it has passed hold enough vectors, and the vectors of those cells are ranked
by their exact distance. How many are enough is measured when the index is fitted:
sampled queries are compared with all sampled vectors. The number of centroids
follows the number of vectors, so cells stay about as full at every size.

Only the centroids and the cell counts are sent to tasks; both are bounded by
``MAX_CENTROIDS``. Cells are joined to the queries that pass them; a cell with many
vectors is split into chunks, each of which answers alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casegate.llm.common import written

# Vectors that a cell holds on average, and the most centroids of a half.
OCCUPANCY, MAX_CENTROIDS = 16, 1024
# Vectors the centroids are fitted on, at most: this many in all, and per centroid.
SAMPLE, SAMPLE_PER_CENTROID = 20_000, 64
# Vectors of a cell that one task compares at once.
CHUNK = 4096
# Steps that deal cells and their parts over bins.
CELL_STEP, PART_STEP = 7919, 104_729


def usable(vector: Column, dims: int) -> Column:
    """Not null, of ``dims`` components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from a seeded choice; an empty cluster keeps its centroid."""
    chosen = np.random.default_rng(seed).permutation(len(points))[:k]
    centroids = points[chosen].astype(np.float64)
    for _ in range(rounds):
        nearest = np.empty(len(points), dtype=np.int64)
        for at in range(0, len(points), 4096):
            part = points[at : at + 4096]
            nearest[at : at + 4096] = ((centroids**2).sum(1) - 2 * part @ centroids.T).argmin(1)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in ascending order of summed distance until they hold ``want`` vectors.

    ``first`` and ``second`` are distances to the centroids of each half, ``counts``
    the vectors by cell. A pair is pushed when both of its lower neighbours have been
    taken, so the heap stays as small as the front.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    front, cells, held = [(first[a[0]] + second[b[0]], 0, 0)], [], 0
    next_of = np.zeros(len(a), dtype=np.int64)  # columns taken so far, by row
    while front and held < want:
        _, i, j = heapq.heappop(front)
        next_of[i] = j + 1
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if i + 1 < len(a) and next_of[i + 1] == j:
            heapq.heappush(front, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or next_of[i - 1] > j + 1):
            heapq.heappush(front, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return cells


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


class Index:
    """A fitted index: centroids of the halves, vectors by cell, counts by cell."""

    def __init__(self, vectors: DataFrame, k: int = 10, recall: float = 0.97, seed: int = 7) -> None:
        """Index ``vectors`` (vec_id, embedding). Vectors that are null, zero, of
        another length than most, or hold a null or non-finite component take no
        part, nor do rows without an id. An id that repeats stands once, with its
        smallest vector. Of equal vectors only the ``k`` + 1 smallest ids are kept as
        candidates, since no more can be among ``k`` nearest; the rest can still ask.
        ``recall`` is what sampled queries must find; it sets the share of the
        vectors that a query passes.
        """
        self.k = k
        source = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        lengths = source.where("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("d")).count()
        top = lengths.orderBy(F.desc("count"), F.desc("d")).first()
        self.dims = max(1, top["d"]) if top else 1
        rows = source.where("vec_id is not null").where(usable(F.col("embedding"), self.dims))
        self.rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
        n = self.rows.count()
        self.size = int(min(MAX_CENTROIDS, max(1, np.ceil(np.sqrt(n / OCCUPANCY)))))
        share = min(1.0, max(SAMPLE, SAMPLE_PER_CENTROID * self.size) / max(1, n))
        draw = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = self.rows.where(draw).orderBy("vec_id").select("embedding").toPandas()
        points = np.stack(sample["embedding"].to_list()) if len(sample) else np.ones((1, self.dims))
        self.half = max(1, self.dims // 2)
        self.first = k_means(points[:, : self.half], self.size, seed)
        self.second = k_means(points[:, self.half :], self.size, seed + 1)
        self.share = self._share(points, recall)
        same = W.partitionBy("embedding").orderBy("vec_id")
        few = self.rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1)
        self.cells = written(
            few.select("vec_id", "embedding").mapInPandas(self._place(), "cell int, vec_id bigint, embedding array<double>"), "cells"
        )
        held = self.cells.groupBy("cell").count().toPandas()
        self.counts = np.zeros(len(self.first) * len(self.second), dtype=np.int64)
        self.counts[held["cell"]] = held["count"]

    def _place(self):
        first, second, half = self.first, self.second, self.half

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    points = np.stack(batch["embedding"].to_list())
                    a = _squares(points[:, :half], first).argmin(1)
                    b = _squares(points[:, half:], second).argmin(1)
                    yield pd.DataFrame(
                        {"cell": (a * len(second) + b).astype(np.int32), "vec_id": batch["vec_id"], "embedding": batch["embedding"]}
                    )

        return place

    def _share(self, points: np.ndarray, recall: float, asked: int = 200) -> float:
        """Share of the vectors to pass so that sampled queries find ``recall`` of
        their nearest in the sample."""
        n = len(points)
        if n <= self.k + 1:
            return 1.0
        a, b = _squares(points[:, : self.half], self.first), _squares(points[:, self.half :], self.second)
        cell = a.argmin(1) * len(self.second) + b.argmin(1)
        counts = np.bincount(cell, minlength=len(self.first) * len(self.second))
        shares = []
        for q in range(0, n, max(1, n // asked)):
            score = ((points - points[q]) ** 2).sum(1)
            score[q] = np.inf
            passed = walk(a[q], b[q], counts, n)
            reached = np.full(len(counts), n)
            reached[passed] = np.cumsum(counts[passed])
            shares += (reached[cell[np.argpartition(score, self.k)[: self.k]]] / n).tolist()
        return float(np.quantile(shares, recall))

    def search(self, asking: Column) -> DataFrame:
        """The ``k`` nearest candidates of every vector for which ``asking`` holds:
        query_id, rank (from 1), vec_id, score (Euclidean distance). A query is not
        its own candidate; equal distances go to the smaller vec_id. A query passes
        cells until they hold its share of the vectors.

        Cells are dealt over bins of about ``CHUNK`` vectors, a cell with more over
        several; a query goes once to each bin that holds a cell it passed.
        """
        first, second, half, counts, k = self.first, self.second, self.half, self.counts, self.k
        chunks = np.maximum(1, -(-counts // CHUNK))
        bins, want = max(1, -(-int(counts.sum()) // CHUNK)), max(1, int(np.ceil(self.share * counts.sum())))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                points = np.stack(batch["embedding"].to_list())
                a, b = _squares(points[:, :half], first), _squares(points[:, half:], second)
                out = []
                for i, (query, vector) in enumerate(zip(batch["vec_id"], batch["embedding"], strict=True)):
                    passed = np.array(walk(a[i], b[i], counts, want), dtype=np.int64)
                    cells = np.repeat(passed, chunks[passed])
                    parts = np.arange(len(cells)) - np.repeat(np.cumsum(chunks[passed]) - chunks[passed], chunks[passed])
                    where = (cells * CELL_STEP + parts * PART_STEP) % bins
                    for one in np.unique(where):
                        out.append((int(one), query, vector, np.unique(cells[where == one]).astype(np.int32)))
                yield pd.DataFrame(out, columns=["bin", "query_id", "vector", "cells"])

        def rank(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(held) and len(asked):
                points, ids = np.stack(held["embedding"].to_list()), held["vec_id"].to_numpy()
                cells = held["cell"].to_numpy()
                for query, vector, passed in zip(asked["query_id"], asked["vector"], asked["cells"], strict=True):
                    near = np.flatnonzero(np.isin(cells, passed) & (ids != query))
                    score = np.sqrt(((points[near] - vector) ** 2).sum(1))
                    best = np.lexsort((ids[near], score))[:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": score[best]}))
            return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        requests = self.rows.where(asking).mapInPandas(
            ask, "bin bigint, query_id bigint, vector array<double>, cells array<int>"
        )
        part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("held") / CHUNK))
        where = F.pmod(F.col("cell").cast("bigint") * CELL_STEP + part * PART_STEP, F.lit(bins))
        held = self.cells.join(self.cells.groupBy("cell").agg(F.count("*").alias("held")), "cell")
        found = (
            held.select(where.alias("bin"), "cell", "vec_id", "embedding")
            .groupBy("bin")
            .cogroup(requests.groupBy("bin"))
            .applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
        )
        nearest = W.partitionBy("query_id").orderBy("score", "vec_id")
        return (
            found.withColumn("rank", F.row_number().over(nearest))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )
