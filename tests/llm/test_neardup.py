import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd

from tests.llm import cases
from casegate.llm import neardup
from casegate.llm.graph import components


def brute(data):
    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in data]
    classes = list(dict.fromkeys(sets))
    links = [{b for b, t in enumerate(classes) if b != a and s and t and len(s & t) >= 0.8 * len(s | t) - 1e-9} for a, s in enumerate(classes)]
    out = []
    for r, s in zip(data, sets, strict=True):
        seen, todo = set(), [classes.index(s)]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += links[a]
        ids = [x[0] for x, t in zip(data, sets, strict=True) if classes.index(t) in seen and x[0] is not None]
        out.append((r[0], min(ids, default=None), sum(t == s for t in sets), len(links[classes.index(s)])))
    return Counter(out)


def joined(docs):
    return Counter((r["doc_id"], r["class_id"], r["copies"], r["links"]) for r in neardup.join(docs).collect())


def test_join_equals_brute_force(spark, monkeypatch):
    base = cases.words(80, seed=2)
    data = cases.rows()
    for i in range(40):  # a group of near copies, some beyond the threshold of each other
        w = list(base)
        for j in range(i % 4):
            w[(7 * i + 31 * j) % 80] = f"new{i}"
        data.append((100 + i, " ".join(w), "en", "a", 0, *data[0][5:]))
    want = brute(data)
    assert joined(cases.documents(spark, data)) == want
    monkeypatch.setattr(neardup, "BLOCK", 8)  # groups cut into blocks
    assert joined(cases.documents(spark, data)) == want


def test_texts_without_ids_are_read_once_per_class(spark, monkeypatch):
    base = cases.words(80, seed=2)
    data = [(None, " ".join([*base[:i], f"new{i}", *base[i + 1 :]]), "en", "a", 0, *cases.rows()[0][5:]) for i in range(60)]
    read, plain = spark.sparkContext.accumulator(0), neardup.blocks

    def counted(texts, *rest):
        read.add(len(texts))
        return plain(texts, *rest)

    monkeypatch.setattr(neardup, "blocks", counted)
    assert joined(cases.documents(spark, data)) == brute(data)
    assert len(data) < read.value <= 3 * len(data)  # sketched, and read again for the classes


def test_join_of_nothing(spark):
    assert neardup.join(cases.empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_pruning_bounds_follow_the_posterior():
    bounds = neardup.least_matches(0.8, 1e-4, 128)
    assert len(bounds) == 8 and bounds == sorted(bounds) and bounds[-1] < 0.8 * 128
    draws = np.random.default_rng(1).random((20_000, 128)) < 0.8
    kept = np.ones(20_000, dtype=bool)
    for i, least in enumerate(bounds):
        kept &= draws[:, : 16 * (i + 1)].sum(axis=1) >= least
    assert kept.mean() > 0.995


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, 300).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.overlaps(sets)
    np.fill_diagonal(got, 0)
    want = np.array(want)
    np.fill_diagonal(want, 0)
    assert (got == want).all()


def test_comparing_two_blocks_takes_bounded_memory():
    rng = np.random.default_rng(3)
    base, rows = rng.integers(0, 1 << 62, 60, dtype=np.uint64), []
    for i in range(1500):
        own = base.copy()
        own[:4] = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
        rows.append((i, 1, 0, 1, 1 + i % 3, i % 2, np.unique(own).tobytes()))
    part = pd.DataFrame(rows, columns=["kid", "component", "p", "q", "copies", "block", "shingles"])
    tracemalloc.start()
    found = pd.concat(neardup._verify(0.8)(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["links"] == 750).all() and found["linked_docs"].sum() == sum(1500 // 2 * r[4] for r in rows)
    assert peak < 10 * 1500**2
