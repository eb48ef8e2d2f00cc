"""Language identification and toxicity."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm import cases
from casegate.llm import langid, toxicity
from casegate.llm.common import fold

ENDINGS = {"en": ["ing", "tion", "ed", "the", "of"], "de": ["ung", "heit", "keit", "der", "sch"], "fr": ["eau", "ment", "oir", "les", "que"]}


def corpus(n=240):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        lang = rng.choice(list(ENDINGS))
        words = ["".join(rng.choice(ENDINGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["foulword", "foulest"])
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_held_out_languages(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, toxic int")
    learned = langid.fit(docs.where(fold(F.col("doc_id")) != 0))
    got = langid.predict(docs, learned).join(docs.drop("text"), "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    docs = cases.documents(spark)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in cases.rows())
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {5, 6, None, 9}
    assert not any(r["accepted"] for r in got if r["lang_pred"] == "und")
    assert langid.fit(cases.empty(spark)) == {}
    assert langid.predict(cases.empty(spark), {}).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}


def test_copies_do_not_thin_out_the_sample(spark):
    rows = [("foo bar baz " * 3, "xx")] * 20_000 + [(f"rare{w} words{w} here{w}", "xx") for w in "abcdef"] + [("delta epsilon", "yy")]
    learned = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_texts=10)
    assert list(learned) == ["xx", "yy"]
    assert all(f" rare{w} ".encode() in learned["xx"] for w in "abcdef") and learned["xx"].count(b"foo") == 3


def test_every_language_is_learned(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n in range(80):
        words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(12)]
        rows += [(100 * n + i, " ".join(rng.sample(words, 10)), f"l{n:02}") for i in range(1 + (n < 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit(docs)
    assert len(learned) == 80
    want = {i: lang for i, _, lang in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, learned).collect()} == want
    engines = [langid.Compressors(learned, group) for group in (7, 80)]
    texts = [t for _, t, _ in rows[:5]] + [None, ""]
    assert engines[0].predict_all(texts) == engines[1].predict_all(texts)


def test_narrow_margins_are_rejected():
    engines = langid.Compressors({"en": b" alpha beta gamma " * 9, "de": b" delta epsilon " * 9})
    assert engines.predict("alpha beta gamma")[0] == "en" and engines.predict("delta epsilon")[0] == "de"
    assert engines.predict("zz") == ("en", 0.0)


def test_held_out_toxicity(spark):
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string, lang string, toxic int")
    learned = fold(F.col("doc_id")) != 0
    labels = docs.where(F.col("doc_id") % 2 == 0).select("doc_id", "toxic")
    models = toxicity.fit(docs.where(learned), labels.where(learned))
    got = toxicity.score(docs, models).join(docs.drop("text"), "doc_id").where(~learned).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)


def test_repeated_ids_do_not_thin_out_the_sample(spark):
    rows = [(0, "plain words of one row")] * 20_000
    rows += [(i, f"foulword other{i % 7}") for i in range(1, 61)] + [(i, f"gentle other{i % 7}") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in {r[0] for r in rows}], "doc_id long, toxic int")
    models = toxicity.fit(docs, labels, positives=100)
    assert len(models) == 4
    assert all(weights.get("foulword", 0) > 0 for weights, _ in models)


def test_toxicity_of_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in cases.rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.fit(docs, labels.where("doc_id = 99")) == []
    assert {r["score"] for r in toxicity.score(docs, []).collect()} == {0.0}
    assert toxicity.score(cases.empty(spark), []).count() == 0


def test_risk_is_corrected_by_the_prior():
    rng = random.Random(3)
    clean = lambda: {rng.choice("abcdefgh") for _ in range(4)}
    positive = [clean() | {"bad"} for _ in range(200)]
    unlabelled = [clean() | ({"bad"} if i % 4 == 0 else set()) for i in range(800)]
    names, weights = toxicity.train(positive, unlabelled, prior=0.25)
    model = [(dict(zip(names, weights, strict=False)), weights[-1])]
    assert toxicity.score_of({"bad", "a"}, model) > 0.5 > toxicity.score_of({"a", "b"}, model)
