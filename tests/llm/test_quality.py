import math
import os
from collections import Counter, defaultdict

import pandas as pd
import pytest

from tests.llm import cases
from casegate.llm import quality
from casegate.llm.common import written


def plain(texts, docs, order, vocab):
    """The same model, in plain recursion over dictionaries."""
    numbers = {w.encode(): i for i, w in enumerate(vocab)}
    kind = lambda w: w if w in numbers else quality._kind(w)
    runs = lambda t: [quality.START] * (order - 1) + [kind(w) for w in quality.words_of(t)] + [quality.END]
    counts = {order: Counter()}
    for t in texts:
        if quality.words_of(t):
            r = runs(t)
            counts[order].update(tuple(r[i - order + 1 : i + 1]) for i in range(order - 1, len(r)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    size = len(vocab) + quality.SPECIAL

    def p(k, gram):
        if k == 0:
            return 1 / size
        d = quality.Model.discounts([sum(n == i for n in counts[k].values()) for i in (1, 2, 3, 4)])
        mine = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return p(k - 1, gram[1:])
        cut = lambda n: d[min(n, 3) - 1]
        own = mine.get(gram, 0)
        return (max(own - cut(own), 0) if own else 0) / total + sum(map(cut, mine.values())) / total * p(k - 1, gram[1:])

    out = []
    for t in docs:
        words, r = quality.words_of(t), runs(t)
        cost = sum(quality.SPELLING * min(len(w), quality.SPELLED) for w in words if w not in numbers)
        total = cost - sum(math.log(p(order, tuple(r[i - order + 1 : i + 1]))) for i in range(order - 1, len(r)))
        out.append(total if words else 0.0)
    return out


TEXTS = ["the cat sat on the mat", "the dog sat on the cat", "a dog and a cat", "the mat! the mat?", "on the dog", None, ""]
DOCS = ["the cat sat on the dog", "a zebra sat 42 times on %%%", "mat mat mat", "x", None, "", "the the cat and a mat"]


@pytest.mark.parametrize("order", [2, 3])
def test_the_filter_holds_all_runs_and_a_full_one_changes_no_answer(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "HOT_RUNS", 2)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    model = quality.Model(texts, order)
    bits = model.run_filter()
    starts = quality.START  # the context of starts only, which no document asks for
    runs = model.weights.where(f"run <> {starts}").toPandas()["run"].to_numpy()
    at, mask = quality.probes(runs, len(bits))
    assert len(runs) and ((bits[at] & mask) == mask).all()
    scores = lambda: {r["doc_id"]: r["nll"] for r in quality.perplexity(docs, model).collect()}
    wide = scores()
    monkeypatch.setattr(quality, "MOST_BITS", 64)
    monkeypatch.setattr(quality, "SEGMENT_BITS", 64)
    assert len(model.run_filter()) == 1
    assert scores() == pytest.approx(wide)


@pytest.mark.parametrize(("order", "hot"), [(2, 3), (2, 10_000), (3, 4)])
def test_perplexity_equals_the_recursion(spark, monkeypatch, order, hot):
    monkeypatch.setattr(quality, "HOT_RUNS", hot)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    model = quality.Model(texts, order, vocabulary=9)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    got = {r["doc_id"]: r["nll"] for r in quality.perplexity(docs, model).collect()}
    vocab = [w.decode() for w in model.vocabulary.numbers]
    want = plain(TEXTS, DOCS, order, vocab)
    assert [got[i] for i in range(len(DOCS))] == pytest.approx(want)


@pytest.mark.parametrize("order", [2, 3])
def test_every_trusted_word_is_known(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "HOT_WORDS", 3)
    monkeypatch.setattr(quality, "HOT_RUNS", 4)
    model = quality.Model(spark.createDataFrame([(t,) for t in TEXTS], "text string"), order)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    got = {r["doc_id"]: r["nll"] for r in quality.perplexity(docs, model).collect()}
    vocab = sorted({w.decode() for t in TEXTS for w in quality.words_of(t)})
    assert 0 < len(model.vocabulary.numbers) <= 3 < len(vocab)
    assert [got[i] for i in range(len(DOCS))] == pytest.approx(plain(TEXTS, DOCS, order, vocab))


def test_judgement_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (10, 0), (None, 1), (1, 0)], "doc_id long, quality int")
    rows = quality.judge(cases.documents(spark), labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in cases.rows())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["kept"] and not by[5][0]["kept"] and not by[6][0]["kept"]
    assert by[5][0]["perplexity"] is None and by[1][0]["perplexity"] < by[10][0]["perplexity"]


def test_nothing_trusted_or_nothing_at_all(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(cases.documents(spark), labels).collect()}
    assert kept[1] and kept[10] and not kept[5]
    assert quality.judge(cases.empty(spark), labels).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_a_task_holds_a_bounded_number_of_runs(order):
    texts = [" ".join(cases.words(40, seed=i % 30)) for i in range(60)] + [None, ""]
    batches, read = [pd.DataFrame({"text": texts[i : i + 2]}) for i in range(0, len(texts), 2)], []
    vocab = quality.Vocabulary(sorted(set(cases.words(40, seed=3))), closed=False)
    whole = pd.concat(quality.run_counts(iter(batches), vocab, order)).sort_values("run")
    assert whole["run"].is_unique and whole["n"].sum() == 60 * 41
    parts = []
    for table in quality.run_counts((read.append(b) or b for b in batches), vocab, order, most=200):
        parts.append((len(read), table))
    assert parts[0][0] < 5 and max(len(t) for _, t in parts) <= 282  # at most 200 and those of one batch
    together = pd.concat([t for _, t in parts])
    summed = together.groupby("run").agg({"n": "sum"} | dict.fromkeys(whole.columns[2:], "first")).reset_index()
    assert summed.equals(whole.reset_index(drop=True))


@pytest.mark.parametrize("order", [2, 3])
def test_counts_packed_by_bucket_are_the_counts(order):
    texts = [" ".join(cases.words(300, seed=i % 7)) for i in range(9)] + [None, "", "the end"]
    vocab = quality.Vocabulary(sorted(set(cases.words(40, seed=3))), closed=False)
    whole = pd.concat(quality.run_counts(iter([pd.DataFrame({"text": texts})]), vocab, order))
    names = list(whole.columns[2:])
    packed = []
    for at in (slice(0, 5), slice(5, 12)):
        for rows in quality.run_counts(iter([pd.DataFrame({"text": texts[at]})]), vocab, order, rows=10_000):
            packed.append(quality.pack_counts(rows, 3))
    packed = pd.concat(packed)
    assert (packed.groupby("bucket").size() <= 2).all() and packed["bucket"].nunique() == 3
    got = pd.concat([quality.merge_counts(part, names) for _, part in packed.groupby("bucket")])
    assert (whole["run"] < 0).any() and (whole["run"] > 0).any()
    order_ = lambda t: t.sort_values("run").reset_index(drop=True)
    assert order_(got).equals(order_(whole))
    spent = sum(len(b) for c in ("runs", "n") for b in packed[c]) + sum(len(b) for row in packed["cold"] for b in row)
    assert order == 3 or spent < 5 * whole.shape[0] * whole.shape[1]  # as rows, 8 each


def test_weights_packed_by_shard_are_found_again():
    rows = pd.DataFrame({"run": [5, -(1 << 62), 1 << 40, -7, 12, 0], "weight": [0.5, -1.25, 3.0, 1e-9, 2.0, 7.0]})
    packed = pd.concat(quality.pack_weights(iter([rows.iloc[:2], rows.iloc[:0], rows.iloc[2:4], rows.iloc[4:]]), 2, most=4))
    assert len(packed) <= 4
    for shard, held in packed.groupby("shard"):
        runs, weights = quality.unpack_weights(held)
        want = rows[quality.shard_of(rows["run"].to_numpy(), 2) == shard].sort_values("run")
        assert runs.tolist() == want["run"].tolist() and weights.tolist() == want["weight"].tolist()
    assert len(quality.unpack_weights(packed.iloc[:0])[0]) == 0


def test_what_tells_a_weight_gives_it(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOT_WORDS", 6)
    model = quality.Model(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    told, weights = (t.toPandas().sort_values("run") for t in (model.told(), model.weights))
    assert told["run"].tolist() == weights["run"].tolist()
    pairs = (told["run"] >= 0).to_numpy()
    assert pairs.any() and not pairs.all()
    told.loc[pairs, "weight"] = model.pair_weights()(told["run"].to_numpy()[pairs], told["weight"].to_numpy()[pairs])
    hot = model.hot(2).toPandas().set_index("run")["weight"]
    frequent = weights[weights["n"] >= 2].set_index("run")["weight"]
    assert len(hot) and hot.to_dict() == pytest.approx(frequent.to_dict(), rel=1e-12)
    assert told["weight"].tolist() == pytest.approx(weights["weight"].tolist(), rel=1e-12)


def test_tables_that_nothing_reads_any_more_are_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "written", lambda df, name, **o: kept.append((name, df_ := written(df, name, **o))) or df_)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, quality int")
    assert quality.judge(cases.documents(spark), labels).count()
    folders = {name: df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/") for name, df in kept}
    there = {name for name, folder in folders.items() if os.path.exists(folder)}
    assert "weights" not in folders and not there & {"trusted", "words", "runs", "singles", "heads"}
    assert {"shards", "perplexity", "scored"} <= there
