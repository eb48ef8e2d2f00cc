"""URL lists over time and nearest neighbours."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegate.llm import ann, urlfilter

D = datetime.date


def test_verdicts_follow_the_entries_of_the_day(spark):
    rng = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.net"]
    entries = [(h, D(2024, 1, 1) + datetime.timedelta(rng.randrange(200)), rng.random() < 0.5) for h in hosts[:4] for _ in range(6)]
    entries += [("A.com.", D(2024, 5, 1), True), ("a.com", D(2024, 5, 1), False), (None, D(2024, 1, 1), True), ("b.org", None, True), ("", D(2024, 1, 1), True)]
    captures = [(i, f"https://u@{rng.choice(hosts).upper()}:80/p?q", D(2023, 12, 1) + datetime.timedelta(rng.randrange(300))) for i in range(200)]
    captures += [(200, None, D(2024, 2, 2)), (201, "not a url", D(2024, 2, 2)), (202, "http://a.com/", None), (203, "http://a.com/", D(2024, 5, 1)), (203, "http://a.com/", D(2024, 5, 1)), (None, "http://c.net", D(2024, 1, 1))]
    cap = spark.createDataFrame([(*c, 1, "d") for c in captures], "page_id long, url string, fetched date, bucket int, domain string")
    got = urlfilter.judge(cap, spark.createDataFrame(entries, "domain string, day date, listed boolean"))

    def verdict(url, day):
        name = (url or "").lower().partition("://")[2].split("/")[0].split("@")[-1].split(":")[0]
        if not name or day is None:
            return "invalid"
        labels = name.split(".")
        for i in range(len(labels)):
            mine = {}
            for h, d, listed in entries:
                if h and d and h.lower().rstrip(".") == ".".join(labels[i:]) and d <= day:
                    mine[d] = mine.get(d, False) or listed
            if mine:
                return "blocked" if mine[max(mine)] else "allowed"
        return "unlisted"

    want = sorted((str(i), verdict(u, d)) for i, u, d in captures)
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got.collect()) == want
    assert {v for _, v in want} == {"blocked", "allowed", "unlisted", "invalid"}


def test_lists_without_entries_or_captures(spark):
    entries = spark.createDataFrame([], "domain string, day date, listed boolean")
    cap = spark.createDataFrame([(1, "http://a.com/", D(2024, 1, 1))], "page_id long, url string, fetched date")
    assert urlfilter.judge(cap, entries).first()["verdict"] == "unlisted"
    assert urlfilter.judge(cap.limit(0), entries).count() == 0


def test_nearest_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    data = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist()) for i in range(600)]
    data += [(1000 + i, [1.0] * 8) for i in range(150)]  # a hot vector
    data += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0, 2.0]), (2005, [float("inf")] * 8), (None, [1.0] * 8), (5, data[5][1])]
    frame = spark.createDataFrame([(i, v, 3, 4) for i, v in data], "vec_id long, embedding array<double>, cell int, bin int")
    got = {}
    for r in ann.Index(frame, k=10).search(F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = {i: np.array(v) for i, v in data if i is not None and (i < 2000)}
    hits = []
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        true = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [found[k][1] for k in range(1, 11)] == sorted(found[k][1] for k in range(1, 11))
        hits += [len({i for _, i in true} & {found[k][0] for k in range(1, 11)}) / 10]
        for k in range(1, 11):
            assert found[k][1] == pytest.approx(float(np.sqrt(((good[found[k][0]] - good[q]) ** 2).sum())))
        if q >= 1000:  # ties go to the smaller id
            assert [found[k][0] for k in range(1, 11)] == [i for _, i in true]
    assert np.mean(hits) >= 0.9


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    rows = ann.Index(frame).search(F.lit(True)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert ann.Index(frame.limit(0)).search(F.lit(True)).count() == 0


def test_the_heap_walks_all_cells_in_order():
    rng = np.random.default_rng(9)
    first, second = rng.random(7), rng.random(5)
    counts = rng.integers(0, 3, 35)
    cells = ann.walk(first, second, counts, 10**9)
    sums = [first[c // 5] + second[c % 5] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(counts))
