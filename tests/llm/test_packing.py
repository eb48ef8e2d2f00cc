import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tests.llm.test_tokens import reference
from casegate.llm import packing
from casegate.llm.catalog import tokenizer_path


def check(rows, ids_of, size):
    """Every id of every document in one piece, sequences without gaps or padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id, copies in ids_of.items():
        pieces = sorted(documents.pop(doc_id))
        assert sum(p[1] for p in pieces) == sum(map(len, copies))
        assert sorted(p[3] for p in pieces if p[0] == 0) == sorted(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, length, crc, total in pieces:
                assert (start, total) == (at, len(copies[0])) and length > 0
                assert crc == zlib.crc32(copies[0][start : start + length].astype("<u4").tobytes())
                at += length
    assert not documents
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return [sum(p[1] for p in s) for s in sequences.values()]


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_hold_every_id_once(spark, tmp_path, parts):
    rng = random.Random(3)
    data = [(100 + i, " ".join(cases.words(rng.randint(0, 120), seed=i)), None, None, 0, *cases.rows()[0][5:]) for i in range(150)]
    docs = cases.documents(spark, cases.rows() + data).repartition(parts)
    made = packing.write_packed(docs, str(tmp_path / "p"), tokenizer_path(), end_id=1, size=256, windows=3, merged=2)
    ids_of = defaultdict(list)
    texts = [(r[0], r[1] or "") for r in cases.rows() + data]
    for (doc_id, _), ids in zip(texts, reference([t for _, t in texts]), strict=True):
        ids_of[doc_id].append(np.append(ids, 1))
    sizes = check(packing.read_pieces(made).collect(), ids_of, 256)
    total = sum(map(len, (c for copies in ids_of.values() for c in copies)))
    assert sum(sizes) == total and sizes.count(256) == total // 256
    # The sequences hold the ids themselves.
    for row in made.collect():
        assert len(packing._numbers(row.asDict())) == row["n_ids"] == sum(row["lengths"])


def test_best_fit_and_cuts():
    held = packing.Windows(10, most=2)
    ids = np.arange(30)

    def added(doc_id, n):
        return [[(d, s, len(x)) for d, s, x, _ in w] for w in held.add((doc_id, 0, ids[:n], n))]

    assert added(1, 6) + added(2, 7) == []
    assert added(3, 3) == [[(2, 0, 7), (3, 0, 3)]] and held.room == [4]
    assert added(4, 25) == [[(4, 0, 10)], [(4, 10, 10)]] and held.room == [4, 5]
    assert added(5, 6) == [[(1, 0, 6), (5, 0, 4)]] and held.room == [3]
    assert [sum(len(p[2]) for p in w) for w in held.close()] == [4, 2, 1]


def test_no_documents(spark, tmp_path):
    made = packing.write_packed(cases.empty(spark), str(tmp_path / "none"), tokenizer_path())
    assert packing.read_pieces(made).count() == 0


def test_one_short_document(spark, tmp_path):
    docs = cases.documents(spark, [r for r in cases.rows() if r[0] == 6])
    rows = packing.read_pieces(packing.write_packed(docs, str(tmp_path / "one"), tokenizer_path())).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in rows] == [(6, 0, 1, 1, 0)]
