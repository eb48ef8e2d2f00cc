"""N-gram Jaccard join: links between documents whose word shingles overlap.

1. Every document becomes the set of its hashed shingles. Documents with equal sets
   are copies: one class, of which one representative goes on.
2. MinHash bands put classes in buckets. Within a bucket pairs are compared value by
   value: after each step the posterior probability of reaching the threshold, given
   the matches so far, decides whether the pair is dropped (BayesLSH). Surviving
   pairs are kept as a spanning forest, never as all pairs of a bucket.
3. Classes that the forests connect are compared exactly, all with all, by matrix
   products over their shingles. Links are counted, and the classes that links
   connect get one id.

Buckets and components with many members are cut into blocks; each pair of blocks is
a group of bounded size, of which a task holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from casegate.llm.common import blocks, mixed, offsets, word_hashes, written
from casegate.llm.graph import components

# Words of a shingle, the least similarity of a link, and the posterior below which a
# pair is dropped.
SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
# MinHash values: bands of so many rows, and values compared at a time.
BANDS, ROWS, STEP = 32, 4, 16
# Classes of a block.
BLOCK = 1024
# Columns and rows of the parts in which overlaps of classes are computed.
WIDTH, STRIP = 1024, 128
# Rows, at most, of the filter that goes to all tasks before texts are read again.
FILTER_SLOTS = 1 << 20
_STEPS = np.random.default_rng(20).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words, given the words' hashes;
    fewer words are one shingle, none are none."""
    n = len(words) - size + 1
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    run = words if n >= 1 else words[None, :].T
    if n < 1:
        joined = np.array([len(words)], dtype=np.uint64)
        for word in run:
            joined = mixed(joined * np.uint64(31) + word)
        return joined
    joined = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        joined = mixed(joined * np.uint64(31) + words[i : i + n])
    return np.unique(joined)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Shingles of texts: words are runs of other than white space, in lower case."""
    words = [t.lower().split() for t in texts]
    edges = offsets(np.array([len(w) for w in words], dtype=np.int64))
    hashes = word_hashes([w for doc in words for w in doc])
    return [shingles(hashes[edges[i] : edges[i + 1]], size) for i in range(len(texts))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each, one row per set."""
    flat = np.concatenate(sets)
    starts = offsets(np.array([len(s) for s in sets], dtype=np.int64))[:-1]
    out = np.empty((len(sets), len(_STEPS)), dtype=np.uint16)
    for i, (a, b) in enumerate(_STEPS):
        out[:, i] = mixed(np.minimum.reduceat(flat * a ^ (flat >> np.uint64(29)) * b, starts)) & np.uint64(0xFFFF)
    return out


def _key(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float, values: int, step: int = STEP) -> list[int]:
    """Matches among the first step, 2 * step, ... values below which the posterior of
    reaching ``threshold`` is under ``tolerance``. With a uniform prior and m matches
    of k, the posterior is the chance of at most m hits in k + 1 draws at the threshold."""
    bounds = []
    for k in range(step, values + 1, step):
        chance, m = 0.0, 0
        while m <= k:
            chance += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        bounds.append(m)
    return bounds


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``keys``, handed on in runs of whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), dtype=bool)
        for k in keys:
            last &= (batch[k] == batch[k].iloc[-1]).to_numpy()
        first = int(len(batch) - np.argmin(last[::-1])) if not last.all() else 0
        opened = not held or all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys)
        if not opened:
            yield pd.concat(held)
            held = []
        if first:
            yield pd.concat([*held, batch.iloc[:first]])
            held = []
        held.append(batch.iloc[first:])
    if held:
        yield pd.concat(held)


def _by_group(df: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Apply ``work`` to rows of whole groups, many small groups at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, keys):
            yield from work(part.reset_index(drop=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(rows, schema)


def _in_blocks(df: DataFrame, size: Column, by: str) -> DataFrame:
    """Deal the rows of a group of ``size`` over blocks and repeat each for every pair
    of blocks it is in: columns block, p and q, with p <= q."""
    count = F.ceil(size / BLOCK).cast("int")
    dealt = df.withColumn("block", F.pmod(F.xxhash64(by), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other")


def _find(roots: np.ndarray, i: int) -> int:
    while roots[i] != i:
        roots[i] = roots[roots[i]]
        i = roots[i]
    return i


def _survivors(bounds: list[int]) -> Callable:
    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        values = np.frombuffer(b"".join(rows["low"]), dtype=np.uint8).reshape(len(rows), -1)
        change = (rows[["bucket", "p", "q"]].diff() != 0).any(axis=1).to_numpy()
        group = np.cumsum(change)
        cross = (rows["p"] != rows["q"]).to_numpy()
        block, nodes = rows["block"].to_numpy(), rows["kid"].to_numpy()
        roots = np.arange(len(rows))
        most = int(np.bincount(group).max())
        edges = []
        for d in range(1, most):
            i = np.flatnonzero(group[d:] == group[:-d])
            i = i[(roots[i] != roots[i + d]) & (~cross[i] | (block[i] != block[i + d]))]
            matches = np.zeros(len(i), dtype=np.int64)
            for step, least in enumerate(bounds):
                if not len(i):
                    break
                part = slice(step * STEP, (step + 1) * STEP)
                matches += (values[i, part] == values[i + d, part]).sum(axis=1)
                keep = matches >= least
                i, matches = i[keep], matches[keep]
            joined = False
            for a in i.tolist():
                x, y = _find(roots, a), _find(roots, a + d)
                if x != y:
                    roots[max(x, y)] = min(x, y)
                    edges.append((nodes[a], nodes[a + d]))
                    joined = True
            if joined:
                while not np.array_equal(flat := roots[roots], roots):
                    roots = flat
        if edges:
            yield pd.DataFrame(edges, columns=["a", "b"])

    return work


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each two sets. Elements of one set only are left
    out; the rest is multiplied in slices of bounded width."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    flat, owner = flat[order], owner[order]
    del order
    same = flat[1:] == flat[:-1]
    del flat
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    new = np.concatenate(([True], ~same))[shared]
    owner, column = owner[shared], np.cumsum(new, dtype=np.int32) - 1
    out, width = np.zeros((len(sets), len(sets)), dtype=np.float32), WIDTH
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        for rows in _strips(len(sets)):
            out[rows] += part[rows] @ part.T
    return out


def _strips(n: int) -> Iterator[slice]:
    """Rows of a matrix, so many that what is made of them stays small."""
    return (slice(at, at + STRIP) for at in range(0, n, STRIP))


def _verify(threshold: float) -> Callable:
    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (_, p, q), part in rows.groupby(["component", "p", "q"], sort=False):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in part["shingles"]]
            nodes, block = part["kid"].to_numpy(), part["block"].to_numpy()
            copies, n = part["copies"].to_numpy(), np.array([len(s) for s in sets])
            both, linked = overlaps(sets), np.empty((len(sets), len(sets)), dtype=bool)
            for i in _strips(len(sets)):
                linked[i] = both[i] >= threshold * (n[i, None] + n[None, :] - both[i]) - 1e-6
                if p != q:
                    linked[i] &= block[i, None] != block[None, :]
            np.fill_diagonal(linked, False)
            del both
            # A breadth-first forest names the classes that links connect.
            partner, open_ = np.full(len(sets), -1), np.ones(len(sets), dtype=bool)
            for seed in range(len(sets)):
                front = np.array([seed]) if open_[seed] else np.empty(0, dtype=np.int64)
                open_[seed] = False
                while len(front):
                    hit = linked[front][:, open_]
                    free = np.flatnonzero(open_)
                    reached = hit.any(axis=0)
                    partner[free[reached]] = front[hit.argmax(axis=0)[reached]]
                    front = free[reached]
                    open_[front] = False
            yield pd.DataFrame(
                {
                    "kid": nodes,
                    "links": linked.sum(axis=1).astype(np.int64),
                    "linked_docs": np.concatenate([linked[i] @ copies.astype(np.int64) for i in _strips(len(sets))]),
                    "partner": pd.array([None if x < 0 else int(nodes[x]) for x in partner], dtype="Int64"),
                }
            )

    return work


def join(
    docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """Links between the documents of ``docs`` (doc_id, text): one row per document.

    Returns doc_id, row_hash (of the text), class_key, class_id, copy_id, copies, links,
    linked_docs. ``copy_id`` is the smallest doc_id among documents with the same set
    of shingles and ``copies`` their number; ``links`` counts the other sets that
    overlap by ``threshold`` or more, ``linked_docs`` the documents that have them;
    ``class_id`` is the smallest doc_id among all documents that copies and links
    connect (null if none has an id) and ``class_key`` a number that only they have. Null and empty texts have no shingles: they are copies of each other and
    link to nothing. Rows that repeat count each. Of pairs at the threshold the bands
    miss one in twenty million, and pruning drops those whose chance to reach it is
    below ``tolerance``; what is linked is exact.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for run in blocks(texts):
                sets = shingle_sets(texts[run], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                found = signatures([sets[i] for i in full]) if full else np.empty((0, len(_STEPS)), dtype=np.uint16)
                bands: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, found, strict=True):
                    bands[i] = row.tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[run].astype("Int64").array,
                        "row_hash": batch["row_hash"].iloc[run].array,
                        "key": [_key(s) for s in sets],
                        "bands": bands,
                    }
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("row_hash"))
    sketched = written(source.mapInPandas(sketch, "doc_id bigint, row_hash bigint, key binary, bands binary"), "sketches")
    nobody = F.lit(-(1 << 63))
    kid = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("bigint")
    classes = written(
        sketched.groupBy("key")
        .agg(
            F.min("doc_id").alias("copy_id"),
            F.count("*").alias("copies"),
            F.first("bands").alias("bands"),
            F.min(F.struct(F.coalesce("doc_id", nobody).alias("id"), "row_hash")).alias("row"),
        )
        .withColumn("kid", kid),
        "classes",
    )

    # Buckets of the bands that hold more than one class.
    banded = classes.where("bands is not null").select(
        "kid",
        "bands",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * 2 * ROWS + 1, F.lit(2 * ROWS))),
            )
        ).alias("bucket"),
    )
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(banded.select("kid", "bucket").join(shared, "bucket"), "members")
    low = F.unhex(F.regexp_replace(F.hex("bands"), "(..)..", "$1")).alias("low")
    held = members.join(classes.select("kid", low), "kid")
    forest = _by_group(
        _in_blocks(held, F.col("size"), "kid").drop("size"),
        ["bucket", "p", "q"],
        _survivors(least_matches(threshold, tolerance, BANDS * ROWS)),
        "a bigint, b bigint",
    )
    together = written(components(forest), "candidates")

    # Exact overlaps within what the forests connect.
    sizes = together.groupBy("component").agg(F.count("*").alias("size"))
    asked = written(
        together.join(sizes, "component").withColumnRenamed("node", "kid").join(classes.drop("bands"), "kid"), "asked"
    )

    def reshingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for run in blocks(texts):
                part = batch.iloc[run].drop(columns="text")
                sets = shingle_sets(texts[run], size)
                same = np.array([_key(s) == k for s, k in zip(sets, part["key"], strict=True)])
                yield part[same].assign(shingles=[s.tobytes() for s, x in zip(sets, same, strict=True) if x]).drop(columns="key")

    # One row stands for each class, found by its id and text: ids may repeat or be null.
    slot = F.pmod(F.xxhash64("id", "row_hash"), F.lit(FILTER_SLOTS)).alias("slot")
    wanted = asked.select("row.id", "row.row_hash", "kid", "key", "component", "size", "copies")
    # A filter of fixed size keeps most texts that nobody asks for out of the shuffle.
    slots = F.broadcast(wanted.select(slot).distinct())
    texts = source.select(F.coalesce("doc_id", nobody).alias("id"), "row_hash", "text").withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    exact = (
        texts.join(wanted.hint("merge"), ["id", "row_hash"])
        .drop("id", "row_hash")
        .mapInPandas(reshingle, "kid bigint, component bigint, size bigint, copies bigint, shingles binary")
    )
    one = written(exact, "shingles").dropDuplicates(["kid"])
    compared = written(
        _by_group(
            _in_blocks(one, F.col("size"), "kid").drop("size"),
            ["component", "p", "q"],
            _verify(threshold),
            "kid bigint, links bigint, linked_docs bigint, partner bigint",
        ),
        "links",
    )
    groups = components(compared.where("partner is not null").select(F.col("kid").alias("a"), F.col("partner").alias("b")))
    counts = compared.groupBy("kid").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    named = written(
        classes.select("key", "kid", "copy_id", "copies")
        .join(counts, "kid", "left")
        .join(groups.withColumnRenamed("node", "kid"), "kid", "left"),
        "named",
    )
    firsts = named.where("component is not null").groupBy("component").agg(F.min("copy_id").alias("first"))
    final = named.join(firsts, "component", "left").select(
        "key",
        F.coalesce("component", "kid").alias("class_key"),
        F.coalesce("first", "copy_id").alias("class_id"),
        "copy_id",
        "copies",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"),
    )
    return sketched.select("doc_id", "row_hash", "key").join(final, "key").drop("key")
