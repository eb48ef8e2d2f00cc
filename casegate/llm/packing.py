"""Documents in sequences of a fixed number of tokens, with hardly any padding.

Every partition packs its documents as they come and keeps a fixed number of windows
open. A document goes to the window that it fits best; where it fits none and no more
may be opened, the fullest is filled with its first ids and emitted, and the rest of it
goes on. What is open at the end of a partition is merged, some partitions at a time,
round by round, until one group is left. Sequences are a Parquet table with their ids
and the pieces of documents that they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.llm.common import folder, per_process
from casegate.llm.tokens import Encoder

# Windows that a task keeps open, and tasks whose open windows are merged by one.
WINDOWS, MERGED = 16, 32
# Rows that a task hands over at once.
BATCH_ROWS = 256
# A sequence's number: round, task and place in the task.
_ROUND, _TASK = 57, 26

SEQUENCES = (
    "sequence_id bigint, open boolean, task int, n_ids int, ids binary, "
    "doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, doc_tokens array<bigint>"
)

# doc_id, ids of the document before the piece, ids, ids of the document
Piece = tuple[int | None, int, np.ndarray, int]


class Windows:
    """The open windows of one task."""

    def __init__(self, size: int, most: int = WINDOWS) -> None:
        self.size, self.most = size, most
        self.open: list[list[Piece]] = []
        self.room: list[int] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece, cut where it must be; the sequences that became full."""
        doc_id, start, ids, doc_tokens = piece
        while len(ids) >= self.size:
            yield [(doc_id, start, ids[: self.size], doc_tokens)]
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            _, k = min(((room, k) for k, room in enumerate(self.room) if room >= len(ids)), default=(0, None))
            if k is not None:
                taken = len(ids)
            elif len(self.open) < self.most:
                k, taken = len(self.open), len(ids)
                self.open.append([])
                self.room.append(self.size)
            else:
                k = min(range(self.most), key=self.room.__getitem__)
                taken = self.room[k]
            self.open[k].append((doc_id, start, ids[:taken], doc_tokens))
            self.room[k] -= taken
            start, ids = start + taken, ids[taken:]
            if not self.room[k]:
                self.room.pop(k)
                yield self.open.pop(k)

    def close(self) -> Iterator[list[Piece]]:
        """What is open, as full sequences and then one for each binary digit of the
        number of ids that remain, the largest first: none of them needs padding."""
        pieces = [piece for window in self.open for piece in window]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for doc_id, start, ids, doc_tokens in pieces:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                window.append((doc_id, start, ids[:room], doc_tokens))
                taken = len(window[-1][2])
                start, ids, room, left = start + taken, ids[taken:], room - taken, left - taken
                if not room:
                    yield window
                    window = []
        self.open, self.room = [], []


def _rows(sequences: Iterator[tuple[list[Piece], bool]], task: int, round_: int, wide: bool) -> Iterator[pd.DataFrame]:
    """Rows of the table, in order of their numbers."""
    rows: list[tuple] = []
    for n, (pieces, left_open) in enumerate(sequences):
        ids = np.concatenate([p[2] for p in pieces])
        number = (round_ << _ROUND) | (task << _TASK) | n
        data = ids.astype("<u4" if wide else "<u2").tobytes()
        rows.append((number, left_open, task, len(ids), data, [p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces], [p[3] for p in pieces]))
        if len(rows) == BATCH_ROWS:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEQUENCES.split(", ")])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEQUENCES.split(", ")])


def _numbers(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], dtype="<u4" if len(row["ids"]) == 4 * row["n_ids"] else "<u2")


def _pieces(row: dict) -> Iterator[Piece]:
    ids, at = _numbers(row), 0
    for doc_id, start, length, doc_tokens in zip(row["doc_ids"], row["starts"], row["lengths"], row["doc_tokens"], strict=True):
        yield None if pd.isna(doc_id) else int(doc_id), int(start), ids[at : at + length], int(doc_tokens)
        at += length


def write_packed(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, size: int = 2048, windows: int = WINDOWS, merged: int = MERGED
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``size`` ids below ``path`` and
    return the table of sequences.

    ``end_id`` closes each document; a null or empty text is that id alone. Every row is
    a document, also one that repeats or has no id, and each of its ids is in one piece.
    A document of any length is cut; one that is longer than ``size`` gives whole
    sequences first. All sequences are full but the last few, whose lengths are powers of
    two. ``tokenizer`` is the path of a tokenizer file on every executor. No documents
    give no sequences. The order of documents within the input does not matter, and
    other columns are not read.
    """

    def encoder() -> Encoder:
        return per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))

    def wide() -> bool:
        return max(encoder().tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) >= 1 << 16

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def sequences() -> Iterator[tuple[list[Piece], bool]]:
            held, end = Windows(size, windows), np.array([end_id], dtype="<u4").tobytes()
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ids = np.frombuffer(encoder().encode(text or "") + end, dtype="<u4")
                    for full in held.add((None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids))):
                        yield full, False
            for pieces in held.open:
                yield pieces, True

        yield from _rows(sequences(), TaskContext.get().partitionId(), 0, wide())

    def merge(round_: int, last: bool):
        def merged_windows(group: pd.DataFrame) -> pd.DataFrame:
            def sequences() -> Iterator[tuple[list[Piece], bool]]:
                held = Windows(size, windows)
                for row in group.sort_values("sequence_id").to_dict("records"):
                    for piece in _pieces(row):
                        for full in held.add(piece):
                            yield full, False
                if last:
                    for pieces in held.close():
                        yield pieces, False
                for pieces in held.open:
                    yield pieces, True

            task = int(group["task"].iloc[0]) // merged
            return pd.concat([*_rows(sequences(), task, round_, wide())])

        return merged_windows

    spark = docs.sparkSession
    options = {"compression": "zstd"}
    docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(pack, SEQUENCES).write.options(**options).parquet(f"{path}/round=0")
    read = lambda n: spark.read.schema(SEQUENCES).parquet(f"{path}/round={n}")
    rounds, left = 0, read(0).where("open")
    most = left.agg(F.max("task")).first()[0]
    while most is not None:
        rounds, last, most = rounds + 1, most < merged, most // merged
        # A group holds the open windows of a fixed number of tasks.
        joined = left.groupBy(F.expr(f"task div {merged}")).applyInPandas(merge(rounds, last), SEQUENCES)
        joined.write.options(**options).parquet(f"{path}/round={rounds}")
        left = read(rounds).where("open")
        if last:
            break
    done = read(0)
    for n in range(1, rounds + 1):
        done = done.unionByName(read(n))
    return done.where("not open").drop("open", "task")


def read_pieces(sequences: DataFrame) -> DataFrame:
    """Pieces of a table of sequences: doc_id, start (its document's ids before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id and offset (its place in the sequence)."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                at = 0
                for doc_id, start, ids, doc_tokens in _pieces(row):
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, row["sequence_id"], at))
                    at += len(ids)
            frame = pd.DataFrame(found, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return sequences.mapInPandas(pieces, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """Pack ``docs`` in the shared folder and read the pieces back."""
    spark: SparkSession = docs.sparkSession
    return read_pieces(write_packed(docs, folder(spark, "packed"), tokenizer, end_id, size))
