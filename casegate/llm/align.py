"""Tokens of two vocabularies over the same text, and how usual their links are.

Both tokenizations of a text are runs of bytes. The byte offsets where runs of both end
are found by intersecting dictionaries from end to index; they cut the two into groups,
and inside a group every pair of tokens that share bytes is linked. A pair's count is
the number of documents that hold it linked.

Neither vocabulary joins anything across a space or a line end between two other
characters, so such a part of a text is aligned once per worker and kept. A first pass
counts pairs; a second one adds up counts, from a bounded set of frequent pairs that goes
to all tasks, and by a join for the rest.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from casegate.llm.common import blocks, offsets, per_process, written

# Parts in a worker's memory, how many of them stay when it is full, and parts that are
# aligned in one call.
KNOWN, STAY, CALL_PARTS = 500_000, 200_000, 128
# Frequent pairs that go to all tasks, and counted pairs that a task holds back.
HOT_PAIRS, HELD_PAIRS = 400_000, 3_000_000
# Frequent pairs are chosen by steps of their count's logarithm.
STEPS = 16


def slices(ends_a: Sequence[int], ends_b: Sequence[int]) -> tuple[list[int], list[int]]:
    """After how many tokens of each side the groups end."""
    index_a = {end: i for i, end in enumerate(ends_a, 1)}
    index_b = {end: i for i, end in enumerate(ends_b, 1)}
    common = sorted(index_a.keys() & index_b.keys())
    return [index_a[end] for end in common], [index_b[end] for end in common]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that share bytes, and where they end to do so:
    inside a slice, each end of either side is where one shared run of bytes ends."""
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[np.flatnonzero(np.diff(ends, prepend=0))]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for (fixed by the
    format): printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Alignments of texts, kept by part."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        vocabulary, byte = self.a.get_vocab(with_added_tokens=True), _byte_of_letter()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, entry)) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        # Each id as text, with what may follow it.
        ids = [str(i) for i in range(max(self.size_a, self.size_b))]
        self.text = np.array([[i + sign for i in ids] for sign in (",", "|", ";", "")], dtype=object)
        self.space = self.b.piece_to_id("▁")
        self.cuts = len(self.ids_a("\n")) == 1 and not any(re.search("\n|[^▁]▁", p) for p in pieces)
        self.version = 0
        self.empty()

    def empty(self) -> None:
        # Number 0 stands for all parts that cannot be cut out.
        self.known: dict[str, int] = {"": 0, "\n": 0}
        self.parts, self.groups = [""], [""]
        self.met = np.zeros(1, dtype=np.int64)
        self.sizes = np.zeros((1, 4), dtype=np.int64)  # tokens of both sides, groups, links
        self.codes, self.edges = np.empty(0, dtype=np.int64), np.zeros(2, dtype=np.int64)
        self.version += 1

    def forget(self) -> None:
        """Keep the parts that were met most."""
        stay = np.sort(np.argsort(-self.met[1:], kind="stable")[:STAY]) + 1
        parts, groups = [self.parts[i] for i in stay], [self.groups[i] for i in stay]
        met, sizes, codes = self.met[stay] // 2, self.sizes[stay], self.gather(stay)[0]
        self.empty()
        self.keep(parts, groups, sizes, codes)
        self.met[1:] = met

    def keep(self, parts: list[str], groups: list[str], sizes: np.ndarray, codes: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))
        self.parts += parts
        self.groups += groups
        self.met = np.concatenate((self.met, np.zeros(len(parts), dtype=np.int64)))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.codes = np.concatenate((self.codes, codes))
        self.edges = offsets(self.sizes[:, 3])

    def ids_a(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def aligned(self, texts: list[bytes], a: list[int], b: list[int]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Groups of each text as text, its sizes, and the codes of linked pairs, if both
        sides are the texts one after another and no token lies in two of them."""
        joined = b"".join(texts)
        if b"".join(map(self.bytes_a.__getitem__, a)) != joined or b"".join(map(self.bytes_b.__getitem__, b)) != joined:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b, stops = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b]), np.cumsum([len(t) for t in texts])
        cuts_a, cuts_b = (np.array(side, dtype=np.int64) for side in slices(ends_a.tolist(), ends_b.tolist()))
        common = ends_a[cuts_a - 1]
        last = np.searchsorted(common, stops)
        if last[-1] >= len(common) or (common[last] != stops).any():
            return None
        at_a, at_b, ends = links(ends_a, ends_b)
        held = np.searchsorted(ends, stops) + 1
        sizes = np.diff(np.stack((cuts_a[last], cuts_b[last], last + 1, held), axis=1), axis=0, prepend=0)
        # What follows each id: more of its side, the other side, the next group, or nothing.
        sign_a, sign_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        sign_a[cuts_a - 1], sign_b[cuts_b - 1] = 1, 2
        sign_b[cuts_b[last] - 1] = 3
        sides = np.concatenate((np.searchsorted(common, ends_a) * 2, np.searchsorted(common, ends_b) * 2 + 1))
        order = np.argsort(sides, kind="stable")
        text = self.text[np.concatenate((sign_a, sign_b))[order], np.concatenate((a, b))[order]].tolist()
        edges = offsets(sizes[:, 0] + sizes[:, 1]).tolist()
        groups = ["".join(text[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        return groups, sizes, a[at_a] * self.size_b + b[at_b]

    def whole(self, text: str) -> tuple[str, tuple, np.ndarray] | None:
        found = self.aligned([(" " + text).encode()], self.ids_a(" " + text), self.b.encode(text)) if text else None
        return found and (found[0][0], tuple(found[1][0].tolist()), found[2])

    def learn(self, parts: list[str]) -> None:
        """Align new parts, the space or line end before them included."""
        new, fresh = [], []
        for part in parts:
            body = part.removeprefix("\n")
            if body.split() == [body]:
                new.append(part)
            else:
                self.known[part] = 0
        for i in range(0, len(new), CALL_PARTS):
            some = new[i : i + CALL_PARTS]
            led = [p if p[0] == "\n" else " " + p for p in some]
            # The second side puts a space before all it encodes.
            b = [ids[1:] if p[0] == "\n" and ids[0] == self.space else ids for p, ids in zip(some, self.b.encode(some, num_threads=1), strict=True)]
            found = self.aligned([p.encode() for p in led], self.ids_a("".join(led)), list(chain.from_iterable(b)))
            if found is not None:
                fresh.append((some, *found))
                continue
            for part, text, ids in zip(some, led, b, strict=True):
                found = self.aligned([text.encode()], self.ids_a(text), ids)
                if found is None:
                    self.known[part] = 0
                else:
                    fresh.append(([part], *found))
        if fresh:
            parts, groups, sizes, codes = zip(*fresh, strict=True)
            self.keep([*chain.from_iterable(parts)], [*chain.from_iterable(groups)], np.concatenate(sizes), np.concatenate(codes))

    def numbered(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all parts of the texts, and where each text's parts begin."""
        cut = [(" " + t).replace("\n", " \n").split(" ")[1:] for t in texts] if self.cuts else [[""] for _ in texts]
        parts = [part for parts in cut for part in parts]
        if len(self.parts) > KNOWN:
            self.forget()
        numbers = np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            some = [parts[i] for i in missing]
            self.learn(list(dict.fromkeys(some)))
            numbers[missing] = [self.known[p] for p in some]
        self.met += np.bincount(numbers, minlength=len(self.met))
        return numbers, offsets(np.array([len(p) for p in cut], dtype=np.int64))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of parts one after another, and how many each has."""
        starts, counts = self.edges[numbers], self.sizes[numbers, 3]
        ends = np.cumsum(counts)
        return self.codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)], counts


def _known_aligner(path_a: str, path_b: str) -> Aligner:
    return per_process(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(numbers: np.ndarray, edges: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different numbers of each text: text, number, occurrences."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keys, counts = np.unique(owner * most + numbers, return_counts=True)
    return keys // most, keys % most, counts


def _pairs_of(aligner: Aligner, texts: Sequence[str]) -> np.ndarray:
    """Codes of each text's different linked pairs, text after text."""
    numbers, edges = aligner.numbered(texts)
    odd = np.add.reduceat(numbers == 0, edges[:-1]) > 0
    owner, number, _ = _distinct(numbers, edges, len(aligner.groups))
    number = np.where(odd[owner], 0, number)
    codes, counts = aligner.gather(number)
    span = aligner.size_a * aligner.size_b
    found = [np.unique(np.repeat(owner, counts) * span + codes) % span]
    for i in np.flatnonzero(odd):
        whole = aligner.whole(texts[i])
        if whole is not None:
            found.append(np.unique(np.array(whole[2], dtype=np.int64)))
    return np.concatenate(found)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """In how many rows of ``docs`` each pair is linked: code (a * size of the second
    vocabulary + b), a, n, best (no pair of a has a larger n)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _known_aligner(path_a, path_b)
        codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for block in blocks(texts):
                found = _pairs_of(aligner, texts[block])
                codes, counts = np.concatenate((codes, found)), np.concatenate((counts, np.ones(len(found), dtype=np.int64)))
                if len(codes) > HELD_PAIRS:
                    codes, counts = _summed(codes, counts)
                if len(codes) > HELD_PAIRS // 2:
                    yield pd.DataFrame({"code": codes, "n": counts, "a": codes // aligner.size_b})
                    codes, counts = codes[:0], counts[:0]
        codes, counts = _summed(codes, counts)
        yield pd.DataFrame({"code": codes, "n": counts, "a": codes // aligner.size_b})

    counted = docs.select("text").mapInPandas(count, "code bigint, n bigint, a bigint")
    pairs = written(counted.groupBy("code", "a").agg(F.sum("n").alias("n")), "align_pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # one row per id of the first vocabulary
    return pairs.join(F.broadcast(most), "a").select("code", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, most: int = HOT_PAIRS) -> pd.DataFrame:
    """The pairs of the largest counts, at most ``most`` of them: code, n, best."""
    step = F.floor(F.log2("n") * STEPS).alias("step")
    sizes = sorted(((r["step"], r["k"]) for r in pairs.groupBy(step).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = None, 0
    for at, k in sizes:  # at most STEPS rows per doubling of the count
        if held + k > most:
            break
        least, held = at, held + k
    chosen = pairs.where(step >= least) if least is not None else pairs.limit(0)
    return chosen.select("code", "n", "best").toPandas()


class Scores:
    """Sums over the pairs of each known part, as far as the frequent pairs tell."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.n, self.best = codes[order], n[order], best[order]
        self.version = -1

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n and best of each pair (0 if it is not frequent), and which are frequent."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        if not len(self.codes):
            return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        found = self.codes[at] == codes
        return np.where(found, self.n[at], 0), np.where(found, self.best[at], 0).astype(np.int64), found

    def follow(self, aligner: Aligner) -> None:
        """Score the parts that the aligner has learned since."""
        if self.version != aligner.version:
            self.version, self.sums = aligner.version, np.zeros((0, 2), dtype=np.int64)
            self.rest, self.rest_edges = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        old = len(self.sums)
        if old == len(aligner.groups):
            return
        first = aligner.edges[old]
        n, best, found = self.of(aligner.codes[first:])
        edges = aligner.edges[old:] - first
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
        self.sums = np.concatenate((self.sums, np.stack((total(best), total(n)), axis=1)))
        self.rest = np.concatenate((self.rest, aligner.codes[first:][~found]))
        self.rest_edges = np.concatenate((self.rest_edges, self.rest_edges[-1] + np.cumsum(total((~found).astype(np.int64)))))


ROWS = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, rest array<bigint>, rest_n array<bigint>"
)


def _scored(aligner: Aligner, scores: Scores, texts: Sequence[str]) -> Iterator[tuple]:
    numbers, edges = aligner.numbered(texts)
    scores.follow(aligner)
    odd = np.add.reduceat(numbers == 0, edges[:-1]) > 0
    total = lambda x: np.add.reduceat(x, edges[:-1])
    sizes, sums = total(aligner.sizes[numbers]).tolist(), total(scores.sums[numbers]).tolist()
    counts = np.diff(scores.rest_edges)[numbers]
    ends = np.cumsum(counts)
    rest = scores.rest[np.arange(ends[-1] if len(ends) else 0) + np.repeat(scores.rest_edges[numbers] - ends + counts, counts)]
    span = aligner.size_a * aligner.size_b
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(edges)), counts)
    keys, times = np.unique(owner * span + rest, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * span).tolist()
    starts, groups = edges.tolist(), aligner.groups
    for i, text in enumerate(texts):
        if odd[i]:
            whole = aligner.whole(text)
            if whole is None:
                yield 0, 0, 0, 0, 0, 0, "", [], []
                continue
            codes = whole[2]
            n, best, found = scores.of(codes)
            left, left_n = np.unique(codes[~found], return_counts=True)
            yield *whole[1], int(best.sum()), int(n.sum()), hashlib.sha256(whole[0].encode()).hexdigest(), left, left_n
        else:
            joined = ";".join([groups[k] for k in numbers[starts[i] : starts[i + 1]].tolist()])
            part = slice(cuts[i], cuts[i + 1])
            yield *sizes[i], *sums[i], hashlib.sha256(joined.encode()).hexdigest(), keys[part] % span, times[part]


def align(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """How tokens of a byte-level vocabulary (``path_a``) and of a sentence-piece one
    (``path_b``) cover each row of ``docs`` (doc_id, text).

    Both read the text with a space before it; strings of special tokens are ordinary
    text. Returns doc_id, n_a, n_b (tokens), n_groups (cut where tokens of both end),
    n_links (pairs of tokens that share bytes), n_best (links whose pair's count is the
    highest among all pairs of its first token, ties included), count_sum (the counts of
    all links) and groups_sha256 (of the groups' ids, ``a1,a2|b1;a3|b2``). A text that
    is null, empty, or that one vocabulary does not give back byte by byte has no tokens:
    zeros, and '' for the hash. Every row is a document, also one that repeats or has no
    id; texts of any length are read whole; other columns are not looked at; no rows give
    no rows. Both paths lead to files on every executor.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pairs = written(pair_counts(rows, path_a, path_b), "align_counts")
    hot = frequent(pairs, hot_pairs)
    run, codes, n, best = uuid.uuid4().hex, hot["code"].to_numpy(dtype="i8"), hot["n"].to_numpy(dtype="i8"), hot["best"].to_numpy(dtype="i1")
    shared = docs.sparkSession.sparkContext.broadcast((codes, n, best))  # at most ``hot_pairs`` entries

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _known_aligner(path_a, path_b)
        kept = per_process("align scores", dict)
        if run not in kept:
            kept.clear()
            kept[run] = Scores(*shared.value)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for block in blocks(texts):
                found = [*_scored(aligner, kept[run], texts[block])]
                names = [c.split()[0] for c in ROWS.split(", ")][2:]
                frame = pd.DataFrame(found, columns=names)
                frame.insert(0, "doc_id", pd.array(batch["doc_id"].iloc[block], dtype="Int64"))
                frame.insert(0, "row", batch["row"].iloc[block].to_numpy())
                yield frame

    scored = written(rows.mapInPandas(score, ROWS), "align_rows")
    left = scored.select("row", F.inline(F.arrays_zip(F.col("rest").alias("code"), F.col("rest_n").alias("times"))))
    more = (
        left.join(pairs, "code")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    return scored.drop("rest", "rest_n").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
