"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of that language, in lower
case. A text is compressed with every dictionary, block by block over its whole
length, and the language whose dictionary leaves the fewest bytes is its language.
The margin to the second says how sure that is; narrow margins are rejected.

Fitting counts the different texts of every language, and draws a sample of them by
hash whose size does not depend on the number of texts or of their copies. Prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

# Sampled texts per language, and the characters of a sampled text that are used:
# together the bound of what is fitted on.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 2_000
DICTIONARY_BYTES = 192 * 1024
# Bytes compressed at once; every block starts from the dictionary anew.
BLOCK = 4_096
LEVEL = 6
# Languages whose digested dictionaries a task holds at once.
GROUP = 64

UNDETERMINED = "und"


_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case, ASCII letters and all beyond ASCII, single spaces in between and at the ends."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" "


class Compressors:
    """One dictionary per language, in the order they are given. They are digested in
    groups of ``group``, of which one is held at a time."""

    def __init__(self, dictionaries: dict[str, bytes], group: int = GROUP) -> None:
        self.names, self.dictionaries = list(dictionaries), dictionaries
        self.groups = [self.names[i : i + group] for i in range(0, len(self.names), group)]
        self.held: int | None = None

    def engines_of(self, number: int) -> list[zstandard.ZstdCompressor]:
        """Compressors of a group, kept until another group is asked for."""
        if self.held == number:
            return self.engines
        self.held, self.engines = number, []
        for name in self.groups[number]:
            held = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.engines.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.engines

    def sizes(self, texts: list[str]) -> list[list[int]]:
        """Compressed bytes of each whole text per language."""
        found: list[list[int]] = [[] for _ in texts]
        for number in range(len(self.groups)):
            engines = self.engines_of(number)
            for text, sizes in zip(texts, found, strict=True):
                whole = folded(text)
                parts = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
                sizes.extend(sum(len(e.compress(p)) for p in parts) for e in engines)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin: the share of bytes saved against the second best. A
        text without letters is undetermined; ties go to the first, margin 0;
        a single learned language has margin 1."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """As ``predict``, for many texts at once."""
        asked = [i for i, t in enumerate(texts) if t is not None and self.names and any(c.isalpha() for c in t)]
        answers = [(UNDETERMINED, 0.0)] * len(texts)
        for i, sizes in zip(asked, self.sizes([texts[i] for i in asked]), strict=True):
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for j, s in enumerate(sizes) if j != best), default=None)
            answers[i] = self.names[best], 1.0 if second is None else (second - sizes[best]) / second
        return answers


def fit(
    docs: DataFrame,
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    seed: int = 11,
) -> dict[str, bytes]:
    """Dictionaries from ``docs`` (text, lang). Rows without either are not used.

    About ``sample_texts`` different texts per language (all, if there are no more) are
    drawn by a seeded hash of the text, each giving ``sample_chars`` characters from a
    drawn place; equal texts count and are drawn once. That bounds what reaches the
    driver per language. Every language is learned; they come with the most frequent
    first. Without texts there is none.
    """
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    scale = 1 << 40
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(scale))
    different = rows.groupBy("lang", draw.alias("draw")).agg(F.count("*").alias("n"))
    counts = (
        different.groupBy("lang")
        .agg(F.sum("n").alias("rows"), F.count("*").alias("texts"))
        .orderBy(F.desc("rows"), "lang")
        .collect()
    )
    if not counts:
        return {}
    rates = [(r["lang"], min(scale, sample_texts * scale // r["texts"])) for r in counts]
    below = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, below bigint"))
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), spare + 1) + 1
    picked = (
        rows.withColumn("draw", draw)
        .join(below, "lang")
        .where("draw < below")
        .select("lang", "draw", F.substring("text", start, F.lit(sample_chars)).alias("text"))
        .groupBy("lang", "draw")
        .agg(F.min("text").alias("text"))
    )
    texts: dict[str, bytes] = {r["lang"]: b"" for r in counts}
    for r in picked.orderBy("lang", "draw").toLocalIterator():
        texts[r["lang"]] = (texts[r["lang"]] + folded(r["text"]))[-dictionary_bytes:]
    return {lang: text for lang, text in texts.items() if text}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text): doc_id, lang_pred, score,
    accepted. ``score`` is the margin, from 0 to 1; rows with a smaller margin than
    ``min_margin`` are not accepted, nor are undetermined ones (null, empty, or
    without a letter), whose lang_pred is ``und``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines = Compressors(dictionaries)
        for batch in batches:
            answers = engines.predict_all(batch["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [a for a, _ in answers],
                    "score": [s for _, s in answers],
                    "accepted": [a != UNDETERMINED and s >= min_margin for a, s in answers],
                }
            )

    source = docs.select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInPandas(rows, "doc_id bigint, lang_pred string, score double, accepted boolean")
