"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other sampled text is unlabelled, for
toxic ones hide among them. The risk of the negative class is that of the unlabelled
minus the prior's share of the positives, and is kept from going below zero, at which
point the step is taken against it, so a classifier cannot win by fitting single
positives. Several numpy classifiers are trained, each by a task on the positives and
its own part of the unlabelled texts of a bounded sample; a score is their mean.

Features are the words of a text and their beginnings. Only those that stand in
positives clearly more often than in unlabelled texts are kept, so the common words
of a long text add nothing. A text is scored from all its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from casegate.llm.common import written

# The bounded sample that is fitted on: texts of each kind, and how many classifiers share it.
POSITIVES, UNLABELLED, CLASSIFIERS = 2_000, 10_000, 4
# Features kept per classifier; how much more often than in negatives a feature must
# stand in positives, and the log likelihood ratio that says it isn't by chance.
FEATURES, LIFT, LEAST_RATIO = 4_000, 3.0, 14.0
STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words in lower case, and the beginnings of longer ones, marked by a star."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


def select(positive: list[set[str]], unlabelled: list[set[str]], prior: float) -> list[str]:
    """Features that stand in positives more often than in negatives, by far and not
    by chance; the strongest first. Negatives are the unlabelled without the positives
    that the prior expects among them."""
    here, there = Counter(), Counter()
    for s in positive:
        here.update(s)
    for s in unlabelled:
        there.update(s)
    kept = []
    for f, n in here.items():
        share = n / len(positive)
        negative = max(there[f] / max(1, len(unlabelled)) - prior * share, 0.0)
        smooth = negative + 1.0 / (len(unlabelled) + 1)
        expected = smooth * len(positive)
        ratio = n * np.log(n / expected) - (n - expected)
        if share >= LIFT * smooth and ratio >= LEAST_RATIO:
            kept.append((-ratio, f))
    return [f for _, f in sorted(kept)[:FEATURES]]


def matrix(texts: Iterable[set[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every feature of the vocabulary that stands in a text."""
    rows, columns = [], []
    for i, found in enumerate(texts):
        for f in found & vocabulary.keys():
            rows.append(i)
            columns.append(vocabulary[f])
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)


def train(
    positive: list[set[str]],
    unlabelled: list[set[str]],
    prior: float,
    rounds: int = 300,
    rate: float = 0.1,
    sparse: float = 5e-4,
) -> tuple[list[str], np.ndarray]:
    """One classifier: its features with a weight and their weights, then the bias.

    Full-batch Adam on the non-negative risk with the logistic loss:
    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)). Weights shrink by
    ``sparse`` a step, so features that few positives have get none.
    """
    names = select(positive, unlabelled, prior)
    vocabulary = {f: i for i, f in enumerate(names)}
    sets = []
    for texts in (positive, unlabelled):
        r, c = matrix(texts, vocabulary)
        sets.append((np.append(r, np.arange(len(texts))), np.append(c, np.full(len(texts), len(names))), len(texts)))
    weights = np.zeros(len(names) + 1)
    weights[-1] = -2.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    squash = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        (pr, pc, pn), (ur, uc, un) = sets
        p = squash(np.bincount(pr, weights[pc], pn))
        u = squash(np.bincount(ur, weights[uc], un))
        up = lambda g, r, c: np.bincount(c, g[r], len(weights))
        positive_risk = prior * up((p - 1) / pn, pr, pc)
        negative_risk = up(u / un, ur, uc) - prior * up(p / pn, pr, pc)
        negative = -np.log1p(-u + 1e-12).mean() + prior * np.log1p(-p + 1e-12).mean()
        slope = (positive_risk + negative_risk if negative >= 0 else -negative_risk)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        pace = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= pace * first / (1 - 0.9**step)
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - pace[:-1] * sparse, 0)
    kept = np.flatnonzero(weights[:-1])
    return [names[i] for i in kept], weights[[*kept, -1]]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    classifiers: int = CLASSIFIERS,
    seed: int = 5,
) -> list[tuple[dict[str, float], float]]:
    """Classifiers from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): weights
    by feature and bias of each.

    Texts whose label is 1 are positives, all others unlabelled. ``prior`` is the share
    of toxic texts among all; without it, their share among the labelled ids. About
    ``positives`` and ``unlabelled`` ids are drawn by a seeded hash, however many rows
    they have, and each different text of a drawn id is used once; each
    classifier sees all of the positives and its own part of the unlabelled. A doc_id with several labels is toxic if any is.
    Without positives there are no classifiers.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kind = (F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    ids = texts.select("doc_id").distinct().join(known, "doc_id", "left")
    count = ids.agg(F.sum(kind).alias("p"), F.count("*").alias("n"), F.count("toxic").alias("known")).first()
    if not count["p"]:
        return []
    share = prior if prior is not None else count["p"] / count["known"]
    scale = 1 << 40
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(scale))
    limit = F.when(kind == 1, F.lit(min(scale, positives * scale // count["p"]))).otherwise(
        F.lit(min(scale, unlabelled * scale // max(1, count["n"] - count["p"])))
    )
    part = (draw % classifiers).cast("int")
    parts = F.when(kind == 1, F.array(*[F.lit(i) for i in range(classifiers)])).otherwise(F.array(part))
    drawn = ids.where(draw < limit).select("doc_id", kind.alias("kind"), F.explode(parts).alias("part")).distinct()
    # As many ids as the bound above; copies of a row count once.
    sample = texts.join(F.broadcast(written(drawn, "sample")), "doc_id").dropDuplicates(["doc_id", "text", "kind", "part"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        sets = {k: [features(t) for t in group["text"][group["kind"] == k]] for k in (0, 1)}
        if not sets[1] or not sets[0]:
            return pd.DataFrame({"names": [], "weights": []}, dtype=object)
        names, weights = train(sets[1], sets[0], share)
        return pd.DataFrame({"names": [names], "weights": [weights.tolist()]})

    models = sample.groupBy("part").applyInPandas(one, "names array<string>, weights array<double>").collect()
    return [(dict(zip(m["names"], m["weights"], strict=False)), m["weights"][-1]) for m in models]


def score_of(found: set[str], models: list[tuple[dict[str, float], float]]) -> float:
    """Mean of the classifiers' probabilities; 0 without classifiers."""
    if not models:
        return 0.0
    logits = [bias + sum(weights[f] for f in found & weights.keys()) for weights, bias in models]
    return float(np.mean(1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))))


def score(docs: DataFrame, models: list[tuple[dict[str, float], float]]) -> DataFrame:
    """Score of every row of ``docs`` (doc_id, text), from 0 to 1: doc_id, score,
    predicted (1 from 0.5). Null and empty texts score by the bias alone."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.array([score_of(features(t), models) for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(rows, "doc_id bigint, score double, predicted int")
