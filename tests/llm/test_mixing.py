import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from casegate.llm import mixing


def shared(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left, out = set(), float(sum(sizes.values())), {}
    while True:
        live = [s for s in names if s not in full]
        if not live:
            return out
        total = sum(weight[s] for s in live)
        out |= {s: left * weight[s] / total for s in live}
        over = [s for s in live if out[s] > 3 * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = 3.0 * sizes[s]
            full.add(s)
            left -= out[s]


def test_targets_and_what_is_taken(spark):
    data = cases.rows()
    for i in range(300):
        data.append((1000 + i, " ".join(cases.words(1 + i % 23, seed=i)), "en", ["a", "b", "c", "z"][i % 4], 0, *data[0][5:]))
    got = mixing.mix(cases.documents(spark, data)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += size(r[1])
    want = shared(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in data)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1 or sizes[s] > 20_000  # one very long text can't be cut
    again = mixing.mix(cases.documents(spark, data[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_taking_keeps_columns_and_repeats_rows(spark):
    docs = cases.documents(spark)
    mixed = mixing.mix(docs)
    rows = mixing.take(docs, mixed)
    assert rows.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows.collect()) == +want


def test_equal_texts_of_two_sources_keep_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (1, "a b", None), (2, "a b", "y")], "doc_id long, text string, source string")
    mixed = spark.createDataFrame([(1, "a b", "x", 2), (1, "a b", "x", 3), (1, "a b", "y", 1), (1, "a b", None, 3), (2, "a b", "y", 0)], "doc_id long, text string, source string, copies int")
    rows = mixing.take(docs, mixed.withColumn("row_hash", mixing.row_hash())).collect()
    assert Counter(map(tuple, rows)) == {(1, "a b", "x"): 5, (1, "a b", "y"): 1, (1, "a b", None): 3}


def test_taking_shuffles_texts_once(spark):
    docs = cases.documents(spark)
    mixed = spark.createDataFrame([], "doc_id long, row_hash long, source string, copies int")
    plan = mixing.take(docs, mixed.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 2 and len({s.count("#") for s in shuffles}) == 1, plan


def test_nothing_to_mix(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0
    only = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.mix(only).collect()] == [(0.0, 0)] * 2


def test_counts_fit_the_budget():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 400, rng.integers(1, 60)))
        counts = rng.integers(1, 50, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        taken = mixing.fit_counts(sizes, counts, budget, table_words=1000)
        assert (taken >= 0).all() and (taken <= counts).all()
        rest = budget - int((sizes * taken).sum())
        assert 0 <= rest < 2 * sizes.max()
    exact = mixing.fit_counts(np.array([3, 5, 7]), np.array([10, 10, 10]), 101)
    assert (exact * [3, 5, 7]).sum() == 101
