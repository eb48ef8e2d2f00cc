import random
import zlib

import numpy as np

from tests.llm import cases
from casegate.llm import tokens
from casegate.llm.catalog import tokenizer_path


def reference(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, dtype="<u4") for e in found]


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    letters = " \n\t a b'sé!1  　x9|~_<|endoftext|>\x1c​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["it's we'll\n\nword,word (a) <|endoftext|> b", " lead", "trail ", "a  b", "été\nNew 12,5%%%"]
    encoder = tokens.Encoder(tokenizer_path())
    assert [encoder.encode(t) for t in texts] == [x.tobytes() for x in reference(texts)]


def test_re_pair_expands_to_what_it_had():
    rng = np.random.default_rng(2)
    for ids in (rng.zipf(1.4, 50_000) % 500, np.zeros(999), np.tile([5, 6, 7], 4000), np.array([]), np.array([3])):
        ids = ids.astype("<u4")
        symbols, rules, ends = tokens.re_pair(ids, 600)
        assert (tokens.expand(symbols, rules, ends, 600) == ids).all()
        assert len(ids) < 100 or len(symbols) < len(ids)
        spans = tokens.spans_of(rules, ends, 600)
        held = np.where(symbols >= 600, spans[np.maximum(symbols - 600, 0)] if len(spans) else 1, 1)
        assert held.sum() == len(ids)


def test_round_trip_and_random_access(spark, tmp_path):
    docs = cases.documents(spark)
    path = str(tmp_path / "shards")
    tokens.write_tokens(docs, path, tokenizer_path(), end_id=2, shard_ids=5000)
    rows = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, d, ids in zip(rows, order, reference([d[1] or "" for d in order]), strict=True):
        ids = np.append(ids, 2).astype("<u4")
        assert (r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) == (d[0], len(ids), zlib.crc32(ids.tobytes()), start)
        start += len(ids)
        shard = spark.read.parquet(path).where(f"task = {r['task']} and part = {r['part']}").first().asDict()
        assert (tokens.Shard(shard).document(r["slot"]) == ids).all()


def test_no_documents(spark, tmp_path):
    tokens.write_tokens(cases.empty(spark), str(tmp_path / "none"), tokenizer_path())
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 500, 700)
    copied = np.concatenate([x for _ in range(40) for x in (passage, rng.integers(0, 500, 30))]).astype("<u4")
    for ids in (copied, (rng.zipf(1.4, 50_000) % 500).astype("<u4"), np.zeros(999, dtype="<u4")):
        symbols, rules, ends = tokens.re_pair(ids, 600, least=12)
        assert (tokens.expand(symbols, rules, ends, 600) == ids).all()
        places = {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
            if i - 1 not in places.setdefault(pair, [])[-1:]:
                places[pair].append(i)
        assert max(map(len, places.values()), default=0) < 12
    symbols, rules, ends = tokens.re_pair(copied, 600, least=12)
    assert tokens.spans_of(rules, ends, 600).max() == len(passage)
    assert len(symbols) < 40 * 35
