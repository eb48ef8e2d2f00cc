import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from casegate.llm import align
from casegate.llm.catalog import tokenizer_path

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def encoded(text):
    """Ids and bytes of both sides of a whole text, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not encoded.__dict__:
        encoded.a, encoded.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
        encoded.a.encode_special_tokens = True
    if not text:
        return None
    found = encoded.a.encode(" " + text, add_special_tokens=False)
    decoder = align._byte_of_letter()
    bytes_a = [bytes(decoder[c] for c in t) for t in found.tokens]
    b = encoded.b.encode(text)
    bytes_b = []
    for i in b:
        piece = encoded.b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if encoded.b.is_byte(i) else piece.replace("▁", " ").encode())
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    return found.ids, b, spans(map(len, bytes_a)), spans(map(len, bytes_b))


def brute(texts):
    """The contract over whole texts, every pair of tokens compared."""
    out, held = [], []
    for text in texts:
        both = encoded(text)
        if both is None:
            out.append([0, 0, 0, 0, ""])
            held.append([])
            continue
        a, b, spans_a, spans_b = both
        pairs = [(a[i], b[j]) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b) if x[0] < y[1] and y[0] < x[1]]
        groups, i, j = [], 0, 0
        for end in sorted({x[1] for x in spans_a} & {y[1] for y in spans_b}):
            m, n = [x[1] for x in spans_a].index(end) + 1, [y[1] for y in spans_b].index(end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        out.append([len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        held.append(pairs)
    counts = Counter(p for pairs in held for p in set(pairs))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(*x[:4], sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), x[4]) for x, pairs in zip(out, held, strict=True)]


def data():
    rng = random.Random(8)
    letters = " \n\t ab'sé!1x9|~_<▁​\x1c　漢"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    odd += ["it's we'll\n\nword,word (a) <|endoftext|> b <s>", " lead", "trail ", "été\nNew 12,5%%%", "a <0x0A> b", "<unk> x", "x▁y z"]
    common = [" ".join(rng.choice(("unbelievable", "tokenisation", "and", "Über-straße,", "x.\nNext")) for _ in range(20)) for _ in range(30)]
    extra = cases.rows()[0][5:]
    rows = [r for r in cases.rows() if len(r[1] or "") < 5000]
    return rows + [(100 + i, t, "en", "s", 0, *extra) for i, t in enumerate(odd + common)]


@pytest.mark.parametrize("hot", [400_000, 60, 0])
def test_same_as_whole_texts(spark, hot):
    rows = data()
    want = sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)
    got = align.align(cases.documents(spark, rows).repartition(3), *PATHS, hot_pairs=hot)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
    assert sum(x[1] == 0 for x in want) > 3 and sum(x[1] > 0 for x in want) > 200


def test_long_text_by_parts_and_whole(spark):
    row = next(r for r in cases.rows() if len(r[1] or "") > 50_000)
    aligner = align.Aligner(*PATHS)
    whole = aligner.whole(row[1])
    got = align.align(cases.documents(spark, [row]), *PATHS).first()
    assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"]) == whole[1]
    assert got["groups_sha256"] == hashlib.sha256(whole[0].encode()).hexdigest()
    assert got["count_sum"] == got["n_links"]


def test_memory_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 10)
    monkeypatch.setattr(align, "STAY", 4)
    aligner = align.Aligner(*PATHS)
    scores = align.Scores(*[np.empty(0, dtype="i8")] * 3)
    for text in ("some words that fill it up and more than ten of them in all", "other words follow here", "some words"):
        (found,) = align._scored(aligner, scores, [text])
        assert found[:4] == aligner.whole(text)[1] and sum(found[8]) == found[3]


def test_no_documents(spark):
    assert align.align(cases.empty(spark), *PATHS).count() == 0
