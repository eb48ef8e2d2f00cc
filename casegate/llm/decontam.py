"""Benchmark decontamination by a positional inverted index.

The index is sharded by document. A shard holds a run of whole documents: its
distinct words, and per word the ascending positions where it stands. Positions
count through the shard with a gap between documents, so that no phrase reaches
over the end of one. Every word of every document is indexed. A query set goes to
all shards; a phrase is found by taking the positions of its rarest word, shifted
to the start of the phrase, and intersecting them with the shifted lists of its
other words, rarest first. Nothing is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from casegate.llm.common import blocks, offsets, word_codes, written

# Words of a query set that go to all shards at once; a larger set makes several passes.
QUERY_WORDS = 2_000_000

INDEX = "shard string, doc_ids array<bigint>, hashes array<bigint>, n_words binary, words binary, counts binary, positions binary"
MATCHES = "shard string, slot int, doc_id bigint, row_hash bigint, n_words bigint, n_hit bigint, hits binary, items array<string>"

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words: A-Z in lower case, then runs of digits, a-z and all characters
    beyond ASCII. Null and empty texts have none."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    task, n, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = ["" if t is None else t for t in batch["text"]]
        for run in blocks(texts):
            words = [words_of(t) for t in texts[run]]
            lengths = np.array([len(w) for w in words], dtype=np.int32)
            flat = [w for doc in words for w in doc]
            codes, distinct = word_codes(flat)
            where = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
            order = np.argsort(codes, kind="stable")
            positions = where[order].astype(np.int32)
            yield pd.DataFrame(
                {
                    "shard": [f"{task}/{n}"],
                    "doc_ids": [[None if pd.isna(i) else int(i) for i in batch["doc_id"].iloc[run]]],
                    "hashes": [batch["row_hash"].iloc[run].tolist()],
                    "n_words": [lengths.tobytes()],
                    "words": [pack(b" ".join(distinct))],
                    "counts": [pack(np.bincount(codes, minlength=len(distinct)).astype(np.int32).tobytes())],
                    "positions": [pack(np.diff(positions, prepend=np.int32(0)).tobytes())],
                }
            )
            n += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index over all words of all texts (doc_id, text), written to the
    shared folder. One row per shard; null texts are documents without words."""
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text"), F.xxhash64("text").alias("row_hash"))
    return written(source.mapInPandas(_index_rows, INDEX), "positions")


class Shard:
    """One shard of the index, unpacked."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        words = unpack(row["words"])
        self.codes = {w: i for i, w in enumerate(words.split(b" "))} if words else {}
        self.starts = offsets(np.frombuffer(unpack(row["counts"]), dtype=np.int32))
        self.positions = np.cumsum(np.frombuffer(unpack(row["positions"]), dtype=np.int32), dtype=np.int32)
        self.n_words = np.frombuffer(row["n_words"], dtype=np.int32)
        self.firsts = offsets(self.n_words + 1)

    def list_of(self, code: int) -> np.ndarray:
        return self.positions[self.starts[code] : self.starts[code + 1]]

    def phrase(self, codes: list[int]) -> np.ndarray:
        """Start positions where all words of the phrase follow each other."""
        rarest = sorted(range(len(codes)), key=lambda j: self.starts[codes[j] + 1] - self.starts[codes[j]])
        found = self.list_of(codes[rarest[0]]) - rarest[0]
        for j in rarest[1:]:
            if not len(found):
                break
            there, want = self.list_of(codes[j]), found + j
            at = np.minimum(np.searchsorted(there, want), len(there) - 1)
            found = found[there[at] == want]
        return found

    def near(self, codes: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest word that have every other word at most
        ``slop`` words before or after them in the same document."""
        lists = sorted((self.list_of(c) for c in set(codes)), key=len)
        found = lists[0]
        doc = np.searchsorted(self.firsts, found, "right") - 1
        low = np.maximum(found - slop, self.firsts[doc])
        high = np.minimum(found + slop, self.firsts[doc + 1] - 2)
        keep = np.ones(len(found), dtype=bool)
        for other in lists[1:]:
            keep &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return found[keep]


class Query:
    """Phrases of a query set: word numbers per phrase, and who asks for each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        phrases: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.words.setdefault(w, len(self.words)) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                phrases.setdefault(ids[i : i + window], set()).update([] if item is None else [item])
        self.phrases = list(phrases)
        self.askers = list(phrases.values())
        self.flat = np.array([w for p in self.phrases for w in p], dtype=np.int64)
        self.first = offsets(np.array([len(p) for p in self.phrases], dtype=np.int64))

    def complete(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Phrases all of whose words stand in the shard, and the shard's codes by word number."""
        codes = np.array([shard.codes.get(w, -1) for w in self.words], dtype=np.int64)
        if not len(self.phrases):
            return np.empty(0, dtype=np.int64), codes
        missing = np.add.reduceat((codes[self.flat] < 0).astype(np.int64), self.first[:-1])
        return np.flatnonzero(missing == 0), codes


def _matcher(query: bytes, slop: int | None):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: Query = pickle.loads(query)
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = Shard(row)
                whole, codes = asked.complete(shard)
                edges = np.zeros(shard.firsts[-1] + 1, dtype=np.int32)
                items: dict[int, set[str]] = {}
                for p in whole:
                    phrase = [int(codes[w]) for w in asked.phrases[p]]
                    if slop is None:
                        found, length = shard.phrase(phrase), len(phrase)
                    else:
                        found, length = shard.near(phrase, slop), 1
                    np.add.at(edges, found, 1)
                    np.add.at(edges, found + length, -1)
                    for doc in np.unique(np.searchsorted(shard.firsts, found, "right") - 1):
                        items.setdefault(int(doc), set()).update(asked.askers[p])
                hit = np.cumsum(edges[:-1]) > 0
                cut = shard.firsts
                n = len(shard.n_words)
                hits = [hit[cut[i] : cut[i + 1] - 1] if i in items else hit[:0] for i in range(n)]
                yield pd.DataFrame(
                    {
                        "shard": [row["shard"]] * n,
                        "slot": np.arange(n, dtype=np.int32),
                        "doc_id": pd.array(row["doc_ids"], dtype="Int64"),
                        "row_hash": np.array(row["hashes"], dtype=np.int64),
                        "n_words": shard.n_words.astype(np.int64),
                        "n_hit": np.array([h.sum() for h in hits], dtype=np.int64),
                        "hits": [np.packbits(h).tobytes() for h in hits],
                        "items": [sorted(items.get(i, ())) for i in range(n)],
                    }
                )

    return rows


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """One document's answers from several passes."""
    first = group.iloc[:1].copy()
    bits = np.zeros(max(map(len, group["hits"])), dtype=np.uint8)
    for h in group["hits"]:
        bits[: len(h)] |= np.frombuffer(h, dtype=np.uint8)
    first["hits"] = [bits.tobytes()]
    first["n_hit"] = int(np.unpackbits(bits).sum())
    first["items"] = [sorted({i for items in group["items"] for i in items})]
    return first


def matches(
    index: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int | None = None,
    query_words: int = QUERY_WORDS,
) -> DataFrame:
    """Every document with the words that items hit in it: shard and slot (its place in
    the index), doc_id, row_hash (of the text), n_words, n_hit, hits, items.

    ``items`` (item_id, text) is the query set. Its phrases are all runs of
    ``window`` words; a shorter item is one phrase, one without words none. Without
    ``slop`` a phrase must stand word for word, and all its words are hit; with it
    all its words must stand within ``slop`` words of its rarest word, which is hit.
    ``hits`` holds one bit per word of the document; ``items`` the distinct ids, as
    strings, of items that hit it. An item without an id hits without being named.

    The query set is sent to all shards at once up to ``query_words`` words, and in
    several passes beyond that, whose bits are united per document.
    """
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // (4 * query_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    answers = []
    for k in range(passes):
        query = Query([tuple(r) for r in asked.filter(part == k).collect()], window)
        answers.append(index.mapInPandas(_matcher(cloudpickle.dumps(query), slop), MATCHES))
    if passes == 1:
        return answers[0]
    together = answers[0]
    for more in answers[1:]:
        together = together.unionByName(more)
    return together.groupBy("shard", "slot").applyInPandas(_merged, MATCHES)


def report(found: DataFrame) -> DataFrame:
    """Counts and digest per document: doc_id, n_words, n_hit, n_items,
    items_sha256 (of the item ids, sorted as strings, joined by commas), contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
