"""Token ids in compressed shards that can be read at any place.

Documents are put in order of their ids, encoded by a given tokenizer and cut into
shards of whole documents. A shard's ids are compressed by Re-Pair: batch by batch, the
pairs of neighbouring symbols that are frequent become new symbols, until no pair is
frequent any more. The file format is a Parquet table with one row per shard: the
rules, how many ids each of them expands to, the remaining symbols, and the documents
with their numbers of ids. Sums over expansion lengths say which symbols hold a given
range of ids, so a document is decoded without the rest of its shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from casegate.llm.common import folder, offsets, per_process

# Ids of a shard (a longer document is a shard of its own), and the least count of a
# pair that becomes a rule.
SHARD_IDS, LEAST_COUNT = 2_000_000, 12
# Entries of the encoder's memory, after which it starts anew.
KNOWN = 1_000_000
# Spreads pairs over slots (golden ratio, 64 bits).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

SHARDS = (
    "task int, part int, before bigint, n_ids bigint, doc_ids array<bigint>, counts binary, "
    "rules binary, spans binary, rounds array<int>, symbols binary, first_rule int"
)

# A run of Latin letters or digits, then one of ASCII punctuation without apostrophes:
# a byte-level tokenizer takes each run as one piece.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[0-9]+|)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte (fixed by the format):
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A byte-level tokenizer reads a space as the start of the word after it. Between
    two characters that are not white space, a text can therefore be cut before the
    space without changing its ids, and every such part is encoded once and kept.
    Texts with other runs of white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}  # parts that follow a space
        self.runs: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def piece(self, text: str) -> bytes:
        """Ids of what the tokenizer takes as one piece."""
        written = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def run(self, text: str) -> bytes:
        """Ids of punctuation, of which there are few kinds."""
        if text not in self.runs:
            if len(self.runs) > KNOWN:
                self.runs.clear()
            self.runs[text] = self.piece(text)
        return self.runs[text]

    def plain(self, found: re.Match, known: dict[str, bytes], lead: str) -> bytes:
        """Ids of a part that is a word and punctuation. The bare word is kept, too."""
        word, after = found.groups()
        if not word:
            return self.run(lead + after)
        ids = known.get(word)
        if ids is None:
            ids = known[word] = self.piece(lead + word)
        return ids + self.run(after) if after else ids

    def learn(self, parts: list[str], known: dict[str, bytes], lead: str) -> bool:
        """Keep the ids of new parts; false if one has white space at an end."""
        if len(known) > KNOWN:
            known.clear()
        rest = []
        for part in {p for p in parts if p not in known}:
            found = _PLAIN.fullmatch(part)
            if found and part:
                known[part] = self.plain(found, known, lead)
                continue
            if not part or part[0].isspace() or part[-1].isspace():
                return False
            lines = part.split("\n")
            words = [_PLAIN.fullmatch(line) for line in lines]
            if all(words) and all(lines):
                ids = self.plain(words[0], known, lead)
                for word in words[1:]:
                    ids += self.run("\n") + self.plain(word, self.first, "")
                known[part] = ids
            else:
                rest.append(part)
        if rest:
            known.update(zip(rest, self.whole([lead + part for part in rest]), strict=True))
        return True

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *later = text.split(" ")
        for _ in range(2):
            try:
                return self.first[first] + b"".join(map(self.later.__getitem__, later))
            except KeyError:
                if not (self.learn([first], self.first, "") and self.learn(later, self.later, " ")):
                    break
        return self.whole([text])[0]


def re_pair(ids: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols, rules (left and right symbol of each, from ``first_rule`` on) and the
    number of rules after each round.

    A round makes a rule of every pair that stands ``least`` times, and replaces it from
    the left where pairs overlap. The next round counts only pairs with a symbol of the
    round before; when none of them is frequent, all pairs are counted once more, so in
    the end no pair stands ``least`` times but in overlaps that give no second place.
    """
    symbols, rules, ends, fresh = ids.astype(np.uint64), [], [], 0
    while len(symbols) > 1:
        big = symbols >= np.uint64(fresh)
        at = np.flatnonzero(big[:-1] | big[1:])
        keys = (symbols[at] << np.uint64(32)) | symbols[at + 1]
        # Counts of slots leave out most pairs that are rare; the rest is sorted.
        slots = ((keys * _SPREAD) >> np.uint64(46)).astype(np.int64)
        some = np.flatnonzero((np.bincount(slots, minlength=1 << 18) >= least)[slots])
        at, keys = at[some], keys[some]
        ranked = np.sort(keys)
        edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else np.zeros(1, dtype=np.int64)
        pairs = ranked[edges[:-1][np.diff(edges) >= least]]
        where, rule, pairs = _chosen(at, keys, pairs)
        if not len(pairs):
            if not fresh:
                break
            fresh = 0
            continue
        fresh = first_rule + sum(map(len, rules))
        symbols[where] = np.uint64(fresh) + rule.astype(np.uint64)
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        symbols = symbols[keep]
        rules.append(pairs)
        ends.append(sum(map(len, rules)))
    flat = np.concatenate(rules) if rules else np.empty(0, dtype=np.uint64)
    sides = np.stack((flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)), axis=1).astype(np.int64)
    return symbols.astype(np.int64), sides, ends


def _chosen(at: np.ndarray, keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are replaced, the number of the pair at each, and the pairs that are
    replaced twice or more. Of two pairs in one slot the later is taken, the other has
    its turn in a later round."""
    if not len(pairs):
        return at[:0], at[:0], pairs
    shift = np.uint64(60 - len(pairs).bit_length())
    rank = np.full(1 << int(64 - shift), -1, dtype=np.int32)
    rank[(pairs * _SPREAD) >> shift] = np.arange(len(pairs))
    rule = rank[(keys * _SPREAD) >> shift]
    match = (rule >= 0) & (keys == pairs[rule])
    where, rule = at[match], rule[match]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(where) > 1)))
    even = (np.arange(len(where)) - np.repeat(starts, np.diff(np.append(starts, len(where))))) & 1 == 0
    where, rule = where[even], rule[even]
    used = np.bincount(rule, minlength=len(pairs)) >= 2
    taken = used[rule]
    return where[taken], (np.cumsum(used) - 1)[rule[taken]], pairs[used]


def spans_of(rules: np.ndarray, ends: list[int], first_rule: int) -> np.ndarray:
    """How many ids each rule expands to. A round's rules use symbols of earlier ones."""
    spans = np.ones(len(rules), dtype=np.int64)
    begin = 0
    for end in ends:
        sides = rules[begin:end]
        held = np.where(sides >= first_rule, spans[np.maximum(sides - first_rule, 0)], 1)
        spans[begin:end] = held.sum(axis=1)
        begin = end
    return spans


class Expansions:
    """The ids that each rule stands for, one rule after another."""

    def __init__(self, rules: np.ndarray, ends: list[int], first_rule: int) -> None:
        self.first_rule, self.spans = first_rule, spans_of(rules, ends, first_rule)
        self.edges = offsets(self.spans)
        self.ids = np.empty(self.edges[-1], dtype=np.int64)
        begin = 0
        for end in ends:
            self.ids[self.edges[begin] : self.edges[end]] = self.of(rules[begin:end].ravel())
            begin = end

    def of(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that the symbols stand for."""
        big = symbols >= self.first_rule
        rule = symbols[big] - self.first_rule
        counts = np.ones(len(symbols), dtype=np.int64)
        counts[big] = self.spans[rule]
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
        out[ends[~big] - 1] = symbols[~big]
        spans = self.spans[rule]
        inside = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        out[np.repeat(ends[big] - spans, spans) + inside] = self.ids[np.repeat(self.edges[rule], spans) + inside]
        return out


def expand(symbols: np.ndarray, rules: np.ndarray, ends: list[int], first_rule: int) -> np.ndarray:
    """All ids that the symbols stand for."""
    return Expansions(rules, ends, first_rule).of(symbols)


class Shard:
    """One shard of a written table."""

    def __init__(self, row: dict) -> None:
        self.first_rule, self.ends = row["first_rule"], [int(e) for e in row["rounds"]]
        self.rules = np.frombuffer(row["rules"], dtype="<u4").astype(np.int64).reshape(-1, 2)
        self.spans = np.frombuffer(row["spans"], dtype="<u4").astype(np.int64)
        low, high = np.frombuffer(row["symbols"], dtype="<u2").astype(np.int64).reshape(2, -1)
        self.symbols = (high << 16) | low
        self.counts = np.frombuffer(row["counts"], dtype="<i8")
        self.expansions = Expansions(self.rules, self.ends, self.first_rule)

    def ids(self) -> np.ndarray:
        return self.expansions.of(self.symbols).astype("<u4")

    def document(self, slot: int) -> np.ndarray:
        """Ids of one document, from the symbols that hold them only."""
        start = int(self.counts[:slot].sum())
        stop = start + int(self.counts[slot])
        held = np.ones(len(self.symbols), dtype=np.int64)
        big = self.symbols >= self.first_rule
        held[big] = self.spans[self.symbols[big] - self.first_rule]
        edges = offsets(held)
        a = np.searchsorted(edges, start, "right") - 1
        b = np.searchsorted(edges, stop, "left")
        some = self.expansions.of(self.symbols[a:b])
        return some[start - edges[a] : stop - edges[a]].astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text), in ascending order of doc_id, to a
    table of shards at ``path``.

    Every row is a document, also one that repeats; rows of one id stand in the order of
    their texts' first 64 characters, then of a hash, those without an id first. A null text is empty. ``end_id`` closes
    each document. ``tokenizer`` is the path of a tokenizer file on every executor.
    """

    def pack(task: int, part: int, before: int, ids: list[bytes], docs_: list, first_rule: int) -> pd.DataFrame:
        counts = np.array([len(x) // 4 for x in ids], dtype="<i8")
        symbols, rules, ends = re_pair(np.frombuffer(b"".join(ids), dtype="<u4"), first_rule)
        return pd.DataFrame(
            {
                "task": [task],
                "part": [part],
                "before": [before],
                "n_ids": [int(counts.sum())],
                "doc_ids": [docs_],
                "counts": [counts.tobytes()],
                "rules": [rules.astype("<u4").tobytes()],
                "spans": [spans_of(rules, ends, first_rule).astype("<u4").tobytes()],
                "rounds": [ends],
                # Lower halves, then upper halves, which are all but equal.
                "symbols": [np.concatenate((symbols & 0xFFFF, symbols >> 16)).astype("<u2").tobytes()],
                "first_rule": [first_rule],
            }
        )

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        first_rule = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        task, part, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, owners, end = [], [], np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                one = encoder.encode(text or "") + end
                if ids and held + len(one) // 4 > shard_ids:
                    yield pack(task, part, before, ids, owners, first_rule)
                    ids, owners, part, before, held = [], [], part + 1, before + held, 0
                ids.append(one)
                owners.append(None if pd.isna(doc_id) else int(doc_id))
                held += len(one) // 4
        if ids:
            yield pack(task, part, before, ids, owners, first_rule)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    order = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInPandas(shards, SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards at ``path``: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers),
    task, part and slot (its place in the table)."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = Shard(row)
                ids, edges = memoryview(shard.ids().tobytes()), offsets(shard.counts)
                yield pd.DataFrame(
                    {
                        "task": row["task"],
                        "part": row["part"],
                        "slot": np.arange(len(shard.counts), dtype=np.int32),
                        "doc_id": pd.array(row["doc_ids"], dtype="Int64"),
                        "inside": row["before"] + edges[:-1],
                        "n_tokens": shard.counts.astype(np.int64),
                        "ids_crc32": np.array([zlib.crc32(ids[4 * edges[i] : 4 * edges[i + 1]]) for i in range(len(shard.counts))], dtype=np.int64),
                    }
                )

    shards = spark.read.schema(SHARDS).parquet(path)
    running = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        shards.groupBy("task")
        .agg(F.sum("n_ids").alias("n"))
        .select("task", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))  # one row per writing task
    )
    found = shards.mapInPandas(
        documents, "task int, part int, slot int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(bases, "task").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "task", "part", "slot"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to the shared folder and read the shards back."""
    path = folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
