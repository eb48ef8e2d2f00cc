"""The pipeline, stage by stage, over a small corpus with planted cases."""

import random
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from casegate.llm.common import written
from tests.llm import cases


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("al", "be", "ga", "de", "mo", "lu") for b in ("ra", "ti", "no", "ses", "vim")]
    tail = cases.rows()[0][5:]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    data = [(i, sentence(rng.randint(30, 80)), ["en", "de", None][i % 3], ["s", "t", None][i % 3], 0, *tail) for i in range(90)]
    item = sentence(14)
    near = data[4][1].split()
    near[len(near) // 2] = "alra" if near[len(near) // 2] != "alra" else "beti"
    data += [
        (200, data[3][1], "en", "t", 0, *tail),  # a copy
        (201, " ".join(near), "de", "s", 0, *tail),  # a near copy
        (201, " ".join(near), "de", "s", 0, *tail),  # the same row again
        (202, f"{sentence(40)} {item} {sentence(40)}", "en", "s", 0, *tail),  # holds a benchmark item
        (203, " ".join(f"qzx{i}%%%" for i in range(40)), "en", "s", 0, *tail),  # junk
        (204, None, None, None, 0, *tail),
        (205, "", "en", "s", 0, *tail),
        (None, sentence(50), "en", "s", 0, *tail),
    ]
    cases.documents(spark, data).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 90), 0) for i in range(0, 90)] + [(203, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, corpus), "stage")
        kept.append(Counter(r["doc_id"] for r in docs.collect()))
        if name != "token output":
            assert docs.columns == columns
    quality, unique, clean, mixed, packed = kept
    assert not {203, 204, 205} & set(quality) and {202, None} <= set(quality) and quality[201] == 2
    assert sum(quality[i] for i in range(90)) >= 85
    near = {3: 200, 4: 201}
    assert max(unique.values()) == 1 and not {200, 201} & set(unique)
    assert set(unique) == {i for i in quality if i not in near.values()}
    assert set(clean) == set(unique) - {202}
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    assert packed == mixed


def test_run_is_registered_and_equals_its_stages(spark, corpus):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, corpus).collect()
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_every_operator_has_its_query():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(contract.oracle_sql()) <= set(contract.queries())
