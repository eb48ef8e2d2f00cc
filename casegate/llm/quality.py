"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

Counting. Words and runs of words are counted over all trusted text; tasks count
their part before anything is shuffled. Every word of trusted text is in the vocabulary.
About ``HOT_WORDS`` most frequent ones (those of one count stand or fall together) are
numbered and known to all tasks; the others have a 64-bit hash as their number, which
is negative. Words that trusted text does not have pay for their letters; where the
vocabulary is closed, words outside it are counted as unknown ones of three kinds.

Scoring. Interpolation makes the log probability of a word a sum over the runs that
end with it: the word's own, and for each longer run that was seen a gain over what
it would be without, besides the context's back-off. What belongs to numbered words is
looked up in arrays. The rest is one weight per run; a hashed word is a run of its own,
whose weight is its gain over an unknown word. The
most frequent runs, a fixed number, go to all tasks, so no run is hot afterwards. So
does a bit filter of all runs of the model, since most runs of ordinary text are not in
it and weigh nothing. Those that pass documents send, packed by block and sorted, to the
shard that holds the run's weight, and sums of weights per document come back. The
lookup there is exact: a run that passes by chance finds nothing.

Judging. A document is kept up to a quantile of the perplexity of trusted documents
of its language that the model has not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from casegate.llm.common import blocks, discard, fold, mixed, offsets, sweep, word_codes, word_hashes, written

# Words, at most, that are numbered for all tasks.
HOT_WORDS = 60_000
# Bits of a word number in the number of a run, and where weights note its length.
BITS, LENGTH_BIT = 17, 58
# Word numbers before the vocabulary: start, end, unknown of letters, digits, others.
START, END, UNKNOWN, SPECIAL = 0, 1, 2, 5
# Nats that each byte of an unknown word costs besides its kind, up to so many bytes.
SPELLING, SPELLED = 2.0, 12
# Runs whose weights go to all tasks, and runs of the model per shard.
HOT_RUNS, SHARD_RUNS = 262_144, 1_000_000
# Different runs, about, that a task counts in memory before it hands them on.
HELD_RUNS = 1_500_000
# Bits per run, and bits at most (32 MB), of the filter of runs; bits of its segments.
# A model beyond that fills the filter: more runs are sent, and the answers are the same.
RUN_BITS, MOST_BITS, SEGMENT_BITS = 8, 1 << 28, 1 << 16
# Rows, at most, of the filter that goes to all tasks before trusted texts are joined.
FILTER_SLOTS = 1 << 20
# A document's score counts so many words of an average one besides its own.
PRIOR_WORDS = 20
_SHARD_PRIME = 1_000_003

_SPACED = bytes(32 if chr(c) in '.,;:"()' else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, cut at white space and common marks; each ! and ? is a word."""
    if not text:
        return []
    return text.lower().encode("utf-8", "replace").translate(_SPACED).replace(b"!", b" ! ").replace(b"?", b" ? ").split()


def _kind(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    return UNKNOWN if text.isalpha() else UNKNOWN + 1 if text.isdigit() else UNKNOWN + 2


def _hashed(words: list) -> np.ndarray:
    """Negative numbers of words that are not numbered."""
    return (word_hashes(words) | np.uint64(1 << 63)).view(np.int64)


class Vocabulary:
    """Numbers of words, and what unknown words cost. Words besides ``words`` are
    unknown if the vocabulary is ``closed``, and else numbered by their hash."""

    def __init__(self, words: list[str], closed: bool = True) -> None:
        self.numbers = {w.encode(): i + SPECIAL for i, w in enumerate(words)}
        self.size = len(words) + SPECIAL
        self.closed = closed

    def encode(self, docs: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, each document led by ``order`` - 1 starts and closed by
        an end; where documents begin; spelling costs of words without such a number, by document."""
        lead = order - 1
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        edges = offsets(lengths + order)
        codes, distinct = word_codes([w for d in docs for w in d])
        if self.closed:
            numbers = np.array([self.numbers.get(w) or _kind(w) for w in distinct], dtype=np.int64)
        else:
            numbers = np.array([self.numbers.get(w, -1) for w in distinct], dtype=np.int64)
            numbers[numbers < 0] = _hashed([w for w in distinct if w not in self.numbers])
        costs = np.array([0.0 if w in self.numbers else SPELLING * min(len(w), SPELLED) for w in distinct])
        out = np.full(edges[-1], START, dtype=np.int64)
        out[edges[1:] - 1] = END
        place = np.arange(len(codes)) + np.repeat(edges[:-1] - offsets(lengths)[:-1] + lead, lengths)
        if len(codes):
            out[place] = numbers[codes]
        spelling = np.add.reduceat(np.append(costs[codes] if len(codes) else [], 0.0), offsets(lengths)[:-1])
        return out, edges, np.where(lengths > 0, spelling, 0.0)


def runs_of(numbers: np.ndarray, edges: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words that end with a word or an end: their numbers and documents.

    The number of a run of numbered words holds their numbers; with a hashed word, it
    is a negative hash. A single word's is the word's own."""
    parts = []
    for back in range(size - 1, -1, -1):
        moved = np.zeros_like(numbers)
        moved[back:] = numbers[: len(numbers) - back]
        parts.append(moved)
    lengths = np.diff(edges)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.arange(len(numbers)) - np.repeat(edges[:-1], lengths) >= order - 1
    return joined([p[ends] for p in parts]), doc[ends]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of runs from those of their words, in order."""
    run = parts[0]
    if len(parts) == 1:
        return run
    for part in parts[1:]:
        run = (run << BITS) | part
    cold = np.flatnonzero(np.any([p < 0 for p in parts], axis=0))
    if len(cold):
        key = np.full(len(cold), len(parts), dtype=np.uint64)
        for part in parts:
            key = mixed(key * np.uint64(31) + part[cold].view(np.uint64))
        run[cold] = (key | np.uint64(1 << 63)).view(np.int64)
    return run


def _parts(numbers: np.ndarray, edges: np.ndarray, order: int) -> pd.DataFrame:
    """Distinct runs of ``order`` words and their counts; of those with a hashed word
    also the runs without their last word (head) and without their first (tail), and
    of three words the two of the tail. Others hold these in their number."""
    words = [runs_of(np.roll(numbers, k), edges, order, 1)[0] for k in range(order - 1, -1, -1)]
    run, first, n = np.unique(joined(words), return_index=True, return_counts=True)
    words = [w[first] for w in words]
    found = {"run": run, "n": n, "head": joined(words[:-1]), "tail": joined(words[1:])}
    if order == 3:
        found |= {"mid": words[1], "last": words[2]}
    return pd.DataFrame({k: v if k in ("run", "n") else np.where(run < 0, v, 0) for k, v in found.items()})


def _summed(held: list[pd.DataFrame]) -> pd.DataFrame:
    """One row per run of several tables of ``_parts``, which are let go one by one."""
    names, tables = held[0].columns, held[::-1]
    held.clear()
    columns: dict[str, list[np.ndarray]] = {c: [] for c in names}
    while tables:
        table = tables.pop()
        for c in names:
            columns[c].append(table[c].to_numpy())
    run = np.concatenate(columns.pop("run"))
    order = np.argsort(run, kind="stable")
    run = run[order]
    new = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    found = {"run": run[new]}
    for c in names[1:]:
        values = np.concatenate(columns.pop(c))
        found[c] = np.add.reduceat(values[order], new) if c == "n" else values[order[new]]
    return pd.DataFrame(found)


def run_counts(
    batches: Iterator[pd.DataFrame], vocab: Vocabulary, order: int, most: int = HELD_RUNS, rows: int = 100_000
) -> Iterator[pd.DataFrame]:
    """Runs of a task's texts (text) and their counts, ``rows`` at a time. A task with more
    different runs than ``most`` gives a run several times, and what it holds does not
    grow further."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        texts = ["" if t is None else t for t in batch["text"]]
        for part in blocks(texts):
            docs = [w for w in map(words_of, texts[part]) if w]
            if docs:
                numbers, edges, _ = vocab.encode(docs, order)
                held.append(_parts(numbers, edges, order))
            if sum(map(len, held)) > most:
                held = [_summed(held)]
                if 2 * len(held[0]) > most:
                    yield from _slices(held.pop(), rows)
    if held:
        yield from _slices(_summed(held), rows)


def _slices(table: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(table), rows):
        yield table.iloc[at : at + rows]


COUNTS = "bucket int, runs binary, n binary, cold array<binary>"


def pack_counts(table: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Counts of ``run_counts`` by bucket, packed in order. Runs of numbered words are
    their numbers. With a hashed word, a run of two words is told by these, which are
    head and tail, and a longer one by all its columns."""
    run = table["run"].to_numpy()
    bucket = shard_of(run, buckets)
    order = np.lexsort((run, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = {c: table[c].to_numpy() for c in table.columns}
    names = [c for c in table.columns if c != "n"]
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[b] : cuts[b + 1]]
        first = np.searchsorted(run[mine], 0)
        cold, mine = mine[:first], mine[first:]
        if len(names) == 3:
            cold = cold[np.lexsort((columns["tail"][cold], columns["head"][cold]))]
            told = [_pack(_deltas(columns["head"][cold])), _pack(columns["tail"][cold])]
        else:
            told = [_pack(columns[c][cold]) for c in names]
        n = columns["n"][np.concatenate((cold, mine))].astype(np.int64)
        out.append((int(b), _pack(_deltas(run[mine])), _pack(n), told))
    return pd.DataFrame(out, columns=["bucket", "runs", "n", "cold"])


def merge_counts(packed: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """One row per run of a bucket, from rows of ``pack_counts``."""
    held = []
    for row in packed.itertuples():
        cold = [_unpack(c, "<i8") for c in row.cold]
        if len(cold) == 2:
            head = np.cumsum(cold[0])
            cold = [joined([head, cold[1]]) if len(head) else head, head, cold[1]]
        mine = np.cumsum(_unpack(row.runs, "<i8"))
        rest = np.zeros(len(mine), dtype=np.int64)
        table = {c: np.concatenate((values, mine if c == "run" else rest)) for c, values in zip(["run", *names], cold, strict=True)}
        held.append(pd.DataFrame({"run": table.pop("run"), "n": _unpack(row.n, "<i8")} | table))
    return _summed(held)


def least_count(table: DataFrame, most: int) -> int:
    """The smallest count ``n`` that at most ``most`` rows of ``table`` reach, from how
    many rows have each count."""
    reached = 0
    for row in table.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        reached += row["count"]
        if reached > most:
            return row["n"] + 1
    return 0


class Model:
    """Counts of trusted text, as weights by run.

    ``vocabulary`` holds the numbered words; ``log_p`` and ``log_back`` the log
    probability and back-off of these by number, ``log_unseen`` the log probability of a
    word that was not counted; ``weights`` (run, weight) those of hashed words and of
    longer runs. ``pair_weights`` gives those of numbered pairs by their counts.
    """

    def __init__(self, texts: DataFrame, order: int = 2, vocabulary: int | None = None) -> None:
        """Count ``texts`` (text). Null and empty texts add nothing; without any text
        all words are equally likely. With ``vocabulary``, only about so many most
        frequent words are known, and all others count as unknown ones."""
        if not 2 <= order <= 3:
            raise ValueError("runs have 2 or 3 words")
        if vocabulary is not None and vocabulary > (1 << BITS) - SPECIAL:
            raise ValueError("a closed vocabulary has to fit the numbers of words")
        self.order = order
        found = written(
            texts.select("text")
            .mapInPandas(_word_counts, "word string, number bigint, cost double, n bigint")
            .groupBy("word", "number", "cost")
            .agg(F.sum("n").alias("n")),
            "words",
        )
        self._words = found
        closed = vocabulary is not None
        least = least_count(found, vocabulary if closed else HOT_WORDS)
        top = found.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select("word").toPandas()
        self.vocabulary = vocab = Vocabulary(top["word"].tolist(), closed)
        rare = found.where(F.lit(not closed) & (F.col("n") < least)).select(F.col("number").alias("run"), "cost", "n")
        size = vocab.size if closed else found.count() + SPECIAL
        names = ["head", "tail", "mid", "last"][: 2 * order - 2]

        buckets = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // SHARD_RUNS))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in run_counts(batches, vocab, order, rows=2 * HELD_RUNS):
                yield pack_counts(rows, buckets)

        def merge(packed: pd.DataFrame) -> pd.DataFrame:
            return merge_counts(packed, names)

        schema = "run bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names)
        counted = written(texts.select("text").mapInPandas(count, COUNTS).groupBy("bucket").applyInPandas(merge, schema), "runs", compression="zstd")
        low = lambda k: F.col("run").bitwiseAND((1 << BITS * k) - 1)
        inner = lambda name, held: F.when(F.col("run") < 0, F.col(name)).otherwise(held).alias(name)
        held = {"head": F.shiftright("run", BITS), "tail": low(order - 1), "mid": F.shiftright(low(2), BITS), "last": low(1)}
        tables = {order: counted.select("run", "n", *[inner(c, held[c]) for c in names])}
        if order == 3:  # how many different words stand before a shorter run
            ends = [F.max("mid").alias("head"), F.max("last").alias("tail")]
            tables[2] = written(tables[3].groupBy(F.col("tail").alias("run")).agg(F.count("*").alias("n"), *ends), "runs")
        tables[1] = written(tables[2].groupBy(F.col("tail").alias("run")).agg(F.count("*").alias("n")), "singles")
        self._rare = rare
        singles = self._single(tables[1], size)
        # Weights of word pairs follow from written tables row by row: they are read where
        # they are needed and not kept besides. Those of three words are sums of rows.
        weights = self._longer(tables, singles)
        self.weights = weights if order == 2 else written(weights, "weights", compression="zstd")
        self.n_runs = tables[order].count()
        self._counts = tables

    def discard(self) -> None:
        """Remove the tables of counts and weights: nothing can be scored afterwards."""
        for kept in [*self._counts.values(), *([self.weights] if self.order > 2 else []), self._words, self._heads]:
            discard(kept)

    def told(self) -> DataFrame:
        """What tells the weight of each run (run, n, weight): the weight, or for pairs of
        numbered words (where ``order`` is 2) their count, of which ``pair_weights`` makes it."""
        if self.order > 2:
            return self.weights
        pairs = self._counts[2].where("run >= 0").select("run", "n", F.col("n").cast("double").alias("weight"))
        return self._cold.unionByName(pairs)

    def pair_weights(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Weights of pairs of numbered words by their runs and counts."""
        total, back, p_held, cuts = self._total, self._back, self._p_held, np.array(self._cuts)

        def weights(run: np.ndarray, n: np.ndarray) -> np.ndarray:
            head, p_tail = run >> BITS, p_held[run & ((1 << BITS) - 1)]
            cut = cuts[np.minimum(n, 3).astype(np.int64) - 1]
            p = np.maximum(n - cut, 0.0) / total[head] + back[head] * p_tail
            return np.log(p) - np.log(np.maximum(back[head], 1e-12)) - np.log(p_tail)

        return weights

    def hot(self, least: int) -> DataFrame:
        """``weights`` of runs that stand ``least`` times or more, if those are few enough
        for all tasks."""
        return self._hot(least) if self.order == 2 else self.weights.where(F.col("n") >= least)

    def hot_count(self, most: int) -> int:
        """From which count on the runs of all lengths are ``most`` or fewer."""
        together = self._counts[self.order].select("n").unionByName(self._rare.select("n"))
        for k in range(2, self.order):
            together = together.unionByName(self._counts[k].select("n"))
        return max(1, least_count(together, most))

    def run_filter(self) -> np.ndarray:
        """The bits of all runs that have a weight, in words whose number grows with the
        runs. Tasks set the bits of theirs, and segments are merged by segment."""
        held = self._rare.select("run")
        for k in range(2, self.order + 1):
            run = F.col("run")
            held = held.unionByName(self._counts[k].select(F.when(run < 0, run).otherwise(run + (k - 2 << LENGTH_BIT)).alias("run")))
        wanted = RUN_BITS * max(1, held.count())
        n_words = min(MOST_BITS, -(-wanted // SEGMENT_BITS) * SEGMENT_BITS) // 64
        per = SEGMENT_BITS // 64

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = np.zeros(n_words, dtype=np.uint64)
            for batch in batches:
                at, mask = probes(batch["run"].to_numpy(np.int64), n_words)
                np.bitwise_or.at(bits, at, mask)
            segments = bits.reshape(-1, per)
            some = np.flatnonzero(segments.any(axis=1))
            for at in range(0, len(some), 256):
                mine = some[at : at + 256]
                yield pd.DataFrame({"segment": mine, "bits": [_pack(segments[i]) for i in mine]})

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for segment, bits in zip(batch["segment"], batch["bits"], strict=True):
                    total[segment] = total.get(segment, np.uint64(0)) | _unpack(bits, "<u8")
            if total:
                yield pd.DataFrame({"segment": list(total), "bits": [_pack(b) for b in total.values()]})

        schema = "segment bigint, bits binary"
        out = np.zeros(n_words, dtype=np.uint64)
        for row in held.mapInPandas(mark, schema).repartition("segment").mapInPandas(merge, schema).toLocalIterator():
            out[row["segment"] * per : (row["segment"] + 1) * per] = _unpack(row["bits"], "<u8")
        return out

    @staticmethod
    def discounts(n: list[int]) -> list[float]:
        """Discounts of counts 1, 2 and 3 or more from how many runs stand 1 to 4 times;
        where a number is missing, half the count."""
        if not all(n[:4]):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return [min(max(d, 0.0), k) for k, d in zip((1, 2, 3), found, strict=True)]

    def _single(self, counts: DataFrame, size: int) -> DataFrame:
        """Probabilities of single words (tail, p_tail)."""
        stands = [F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]
        *tally, rows, total = counts.agg(*stands, F.count("*"), F.sum("n")).first()
        d = self.discounts(tally)
        kept = d[0] * tally[0] + d[1] * tally[1] + d[2] * (rows - tally[0] - tally[1])
        unseen = kept / total / size if total else 1.0 / size
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        p = F.greatest(F.col("n") - cut, F.lit(0.0)) / F.lit(float(total or 1)) + F.lit(unseen)
        singles = counts.select(F.col("run").alias("tail"), p.alias("p_tail"))
        held = singles.where("tail >= 0").toPandas()  # at most as many rows as numbered words
        p_held = np.full(self.vocabulary.size, unseen)
        p_held[held["tail"].to_numpy(np.int64)] = held["p_tail"]
        self.log_unseen = float(np.log(unseen))
        self._p_held = p_held
        self.log_p = np.log(p_held)
        self.log_p[START] = 0.0  # never predicted
        self.log_back = np.zeros(self.vocabulary.size)
        return singles

    def _longer(self, tables: dict[int, DataFrame], lower: DataFrame) -> DataFrame:
        spark = tables[self.order].sparkSession

        def beside(rows: DataFrame, heads: tuple[DataFrame, DataFrame], tails: tuple[DataFrame, DataFrame], few: bool) -> DataFrame:
            """``rows`` with what is known of their heads and tails, each by numbered and by
            hashed words: the first, which may be in many rows, go to all tasks, and only
            rows of hashed words are shuffled, as long as they are slim, or go to all
            tasks as well if they are ``few``."""
            sent = F.broadcast if few else lambda rows: rows
            in_head, in_tail = F.col("head") < 0, F.col("tail") < 0
            numbered = rows.where(~in_head & ~in_tail).join(F.broadcast(heads[0]), "head").join(F.broadcast(tails[0]), "tail")
            by_tail = sent(rows.where(~in_head & in_tail)).join(tails[1], "tail").join(F.broadcast(heads[0]), "head")
            by_head = sent(rows.where(in_head & ~in_tail)).join(heads[1], "head").join(F.broadcast(tails[0]), "tail")
            by_both = sent(sent(rows.where(in_head & in_tail)).join(tails[1], "tail")).join(heads[1], "head")
            return numbered.unionByName(by_tail).unionByName(by_head).unionByName(by_both)

        def parted(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
            numbered = spark.createDataFrame(side.where(F.col(name) >= 0).toPandas(), side.schema)
            return numbered, side.where(F.col(name) < 0)

        out = None
        for k in range(2, self.order + 1):
            table = tables[k].select("run", "n", "head", "tail")
            tally = table.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
            d1, d2, d3 = self.discounts(list(tally))
            cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            back = (F.sum("cut") / F.sum("n")).alias("back")
            heads = table.select("head", "n", cut.alias("cut")).groupBy("head").agg(F.sum("n").alias("total"), back)
            rows = table.withColumn("cut", cut)
            if k == 2:
                self._heads = heads = written(heads, "heads")
                held = heads.where("head >= 0").toPandas()
                self.log_back[held["head"]] = np.log(np.maximum(held["back"], 1e-12))
                self._total, self._back, self._cuts = np.ones(self.vocabulary.size), np.ones(self.vocabulary.size), (d1, d2, d3)
                self._total[held["head"]], self._back[held["head"]] = held["total"], held["back"]
                own = F.log("p_tail") - F.lit(self.log_unseen) + F.col("cost") + F.log(F.greatest("back", F.lit(1e-12)))
                words = parted(heads, "head"), parted(lower, "tail")
                ends, starts = lower.withColumnRenamed("tail", "run"), heads.withColumnRenamed("head", "run")

                def singles(rare: DataFrame, few: bool = False) -> DataFrame:
                    held = (F.broadcast(rare) if few else rare).join(ends, "run")
                    return (F.broadcast(held) if few else held).join(starts, "run").select("run", "n", own.alias("weight"))

                def pairs(rows: DataFrame, few: bool = False) -> DataFrame:
                    return beside(rows.drop("cut"), *words, few).withColumn("cut", cut)

                out = singles(self._rare)
                held = pairs(rows)
            else:
                held = rows.join(heads, "head").join(lower, "tail")
            known = lambda held: held.select(
                "run",
                "n",
                "head",
                F.greatest("back", F.lit(1e-12)).alias("back"),
                F.col("p_tail"),
                (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("p_tail")).alias("p"),
            )
            table_, rows = rows, known(held)
            tag = lambda run, size: F.when(run < 0, run).otherwise(run + (size - 2 << LENGTH_BIT))
            gains = lambda rows: rows.select(tag(F.col("run"), k).alias("run"), "n", (F.log("p") - F.log("back") - F.log("p_tail")).alias("weight"))
            gain = gains(rows)
            if k > 2:  # contexts of the longest runs are runs themselves
                backs = heads.select(tag(F.col("head"), k - 1).alias("run"), F.lit(0).cast("bigint").alias("n"), F.log(F.greatest("back", F.lit(1e-12))).alias("weight"))
                out = out.unionByName(gain).unionByName(backs).groupBy("run").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"))
            else:
                self._cold = out.unionByName(gain.where("run < 0"))

                def hot(least: int) -> DataFrame:
                    enough = F.col("n") >= least
                    return singles(self._rare.where(enough), few=True).unionByName(gains(known(pairs(table_.where(enough), few=True))))

                self._hot = hot
                out = out.unionByName(gain)
            lower = rows.select(F.col("run").alias("tail"), F.col("p").alias("p_tail"))
        return out


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a task's texts and how often they stand."""
    held: list[pd.Series] = []
    for batch in batches:
        rows = ["" if t is None else t for t in batch["text"]]
        for part in blocks(rows):
            codes, distinct = word_codes([w for t in rows[part] for w in words_of(t)])
            held.append(pd.Series(np.bincount(codes, minlength=len(distinct)), index=distinct, dtype=np.int64))
        if sum(map(len, held)) > 1_000_000:
            held = [pd.concat(held).groupby(level=0, sort=False).sum()]
    if held:
        total = pd.concat(held).groupby(level=0, sort=False).sum()
        if len(total):
            words = [w.decode("utf-8", "replace") for w in total.index]
            costs = [SPELLING * min(len(w), SPELLED) for w in total.index]
            yield pd.DataFrame({"word": words, "number": _hashed(list(total.index)), "cost": costs, "n": total.to_numpy()})


def probes(run: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs stand in a filter of ``n_words`` words, and their two bits there."""
    key = mixed(run.view(np.uint64))
    bit = lambda shift: np.uint64(1) << ((key >> np.uint64(shift)) & np.uint64(63))
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64), bit(52) | bit(58)


MESSAGES = "shard int, block string, n_docs int, runs binary, sizes binary, owners binary, doc_ids array<bigint>, hashes array<bigint>, base binary, words binary"


def _pack(array: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: the high ones hardly take room."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return planes.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _deltas(array: np.ndarray) -> np.ndarray:
    """Steps of sorted numbers, of which ``cumsum`` makes them again."""
    return np.diff(array, prepend=np.int64(0))


def pack_weights(batches: Iterator[pd.DataFrame], shards: int, most: int = SHARD_RUNS) -> Iterator[pd.DataFrame]:
    """Rows (run, weight) by shard, packed in the order of their runs, of which a task
    holds about ``most`` at a time."""
    held: list[pd.DataFrame] = []

    def packed() -> pd.DataFrame:
        run = np.concatenate([b["run"].to_numpy(np.int64) for b in held])
        weight = np.concatenate([b["weight"].to_numpy(np.float64) for b in held])
        held.clear()
        shard = shard_of(run, shards)
        order = np.lexsort((run, shard))
        run, weight, shard = run[order], weight[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        out = [
            (int(s), _pack(_deltas(run[cuts[s] : cuts[s + 1]])), _pack(weight[cuts[s] : cuts[s + 1]]))
            for s in np.flatnonzero(np.diff(cuts))
        ]
        return pd.DataFrame(out, columns=["shard", "runs", "weights"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= most:
            yield packed()
    if held:
        yield packed()


def unpack_weights(held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one shard in order, and their weights, from rows of ``pack_weights``."""
    if not len(held):
        return np.empty(0, dtype=np.int64), np.empty(0)
    runs = np.concatenate([np.cumsum(_unpack(r, "<i8")) for r in held["runs"]])
    weights = np.concatenate([_unpack(w, "<f8") for w in held["weights"]])
    order = np.argsort(runs, kind="stable")
    return runs[order], weights[order]


def shard_of(run: np.ndarray, shards: int) -> np.ndarray:
    return (run % _SHARD_PRIME) % shards


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """Log perplexity of every row of ``docs`` (doc_id, text): doc_id, row_hash (of the
    text), n_words, nll (nats over all its words and its end). Null and empty texts
    have no words and nll 0. What is returned no longer reads the tables of ``model``."""
    order, vocab = model.order, model.vocabulary
    log_p, log_back, log_unseen = model.log_p, model.log_back, model.log_unseen
    least = model.hot_count(HOT_RUNS)
    hot = model.hot(least).select("run", "weight").toPandas().sort_values("run")
    hot_runs, hot_weights = hot["run"].to_numpy(np.int64), hot["weight"].to_numpy(np.float64)
    starts = 0.0
    if order == 3:  # the context of starts only, which is no run of a document
        first = model.weights.where(F.col("run") == START).first()
        starts = first["weight"] if first else 0.0
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(model.run_filter())
    shards = max(spark.sparkContext.defaultParallelism, -(-model.n_runs // SHARD_RUNS), -(-docs.rdd.getNumPartitions() // 2))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = ["" if t is None else t for t in batch["text"]]
            for part in blocks(rows):
                texts = [words_of(t) for t in rows[part]]
                numbers, edges, spelling = vocab.encode(texts, order)
                n, name = len(texts), f"{task}/{number}"
                number += 1
                single, owner = runs_of(numbers, edges, order, 1)
                base = np.bincount(owner, np.where(single < 0, log_unseen, log_p[np.maximum(single, 0)]), n) - spelling + starts
                before = numbers[np.flatnonzero(np.arange(len(numbers)) - np.repeat(edges[:-1], np.diff(edges)) >= order - 1) - 1]
                base += np.bincount(owner, np.where(before < 0, 0.0, log_back[np.maximum(before, 0)]), n)
                parts = [runs_of(numbers, edges, order, k) for k in range(2, order + 1)]
                parts = [(np.where(r < 0, r, r + (k << LENGTH_BIT)), d) for k, (r, d) in enumerate(parts)]
                parts.append((single[single < 0], owner[single < 0]))
                run = np.concatenate([r for r, _ in parts])
                doc = np.concatenate([d for _, d in parts])
                if len(hot_runs):
                    at = np.minimum(np.searchsorted(hot_runs, run), len(hot_runs) - 1)
                    known = hot_runs[at] == run
                    base += np.bincount(doc[known], hot_weights[at[known]], n)
                    run, doc = run[~known], doc[~known]
                at, mask = probes(run, len(bits.value))
                maybe = (bits.value[at] & mask) == mask
                run, doc = run[maybe], doc[maybe]
                shard = shard_of(run, shards)
                order_ = np.lexsort((doc, run, shard))
                run, doc, shard = run[order_], doc[order_], shard[order_]
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                out = []
                for s in np.flatnonzero(np.diff(cuts)):
                    mine, owners = run[cuts[s] : cuts[s + 1]], doc[cuts[s] : cuts[s + 1]]
                    new = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                    distinct = mine[new]
                    out.append(
                        (int(s), name, n, _pack(_deltas(distinct)), _pack(np.diff(np.append(new, len(mine))).astype(np.uint32)), _pack(owners.astype(np.uint32)), None, None, None, None)
                    )
                ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].iloc[part]]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                out.append((zlib.crc32(name.encode()) % shards, name, n, None, None, None, ids, batch["row_hash"].iloc[part].tolist(), base.tobytes(), sizes.tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    def answer(key: tuple, sent: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        runs, weights = unpack_weights(held)
        if pair_weights is not None:
            first = np.searchsorted(runs, 0)
            weights[first:] = pair_weights(runs[first:], weights[first:])
        out = []
        for m in sent.itertuples():
            if m.runs is None:
                out.append((m.block, m.shard, None, None, m.doc_ids, m.hashes, m.base, m.words))
                continue
            asked = np.cumsum(_unpack(m.runs, "<i8"))
            gain = np.zeros(len(asked))
            if len(runs):
                at = np.minimum(np.searchsorted(runs, asked), len(runs) - 1)
                gain = np.where(runs[at] == asked, weights[at], 0.0)
            sums = np.bincount(_unpack(m.owners, "<u4"), np.repeat(gain, _unpack(m.sizes, "<u4")), m.n_docs)
            some = np.flatnonzero(sums)
            if len(some):
                out.append((m.block, m.shard, _pack(np.diff(some, prepend=0).astype(np.uint32)), _pack(sums[some]), None, None, None, None))
        return pd.DataFrame(out, columns=["block", "shard", "slots", "sums", "doc_ids", "hashes", "base", "words"], dtype=object)

    def settle(parts: pd.DataFrame) -> pd.DataFrame:
        head = parts[parts["base"].notna()].iloc[0]
        total = np.frombuffer(head["base"]).copy()
        parts = parts.sort_values("shard")  # sums in one order, whatever came first
        for at, gained in zip(parts["slots"].dropna(), parts["sums"].dropna(), strict=True):
            total[np.cumsum(_unpack(at, "<u4"))] += _unpack(gained, "<f8")
        sizes = np.frombuffer(head["words"], dtype=np.int64)
        ids = pd.array([None if pd.isna(i) else int(i) for i in head["doc_ids"]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "row_hash": head["hashes"], "n_words": sizes, "nll": np.where(sizes > 0, -total, 0.0)})

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("row_hash"))
    others = model.told().where(F.col("n") < least).select("run", "weight")
    pair_weights = model.pair_weights() if order == 2 else None
    sharded = written(others.mapInPandas(lambda rows: pack_weights(rows, shards), "shard int, runs binary, weights binary"), "shards")
    answers = (
        source.mapInPandas(send, MESSAGES)
        .groupBy("shard")
        .cogroup(sharded.groupBy("shard"))
        .applyInPandas(answer, "block string, shard int, slots binary, sums binary, doc_ids array<bigint>, hashes array<bigint>, base binary, words binary")
    )
    return answers.groupBy("block").applyInPandas(settle, "doc_id bigint, row_hash bigint, n_words bigint, nll double")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    order: int = 2,
    quantile: float = 0.995,
    vocabulary: int | None = None,
    prior_words: int = PRIOR_WORDS,
) -> DataFrame:
    """Quality of every row of ``docs`` (doc_id, text, lang) by ``labels`` (doc_id, quality).

    Documents labelled 1 are trusted. Those of four folds in five are counted; those of
    the fifth, which the model has not seen, say what is usual. Returns doc_id,
    row_hash, lang, n_words, perplexity, score, threshold, kept. ``score`` is the log
    perplexity with ``prior_words`` words of the language's mean added, so a short text
    needs more evidence; ``threshold`` is the ``quantile`` of the score among trusted
    documents of the language, or among all of them for a language without any; a null
    lang is a language of its own. A text without words has perplexity null and is not
    kept. Without trusted documents everything with words is kept.
    """
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    # A filter of fixed size keeps most other texts out of the shuffle.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS)).alias("slot")
    counted = trusted.where(fold(F.col("doc_id")) != 0)
    texts = docs.select("doc_id", "text").withColumn("slot", slot)
    near = texts.join(F.broadcast(counted.select(slot).distinct()), "slot", "left_semi")
    chosen = written(near.join(counted.hint("merge"), "doc_id", "left_semi").select("text"), "trusted", compression="zstd")
    model = Model(chosen, order, vocabulary)
    discard(chosen)  # its counts are written
    sweep(docs.sparkSession)
    scores = perplexity(docs, model)
    model.discard()
    sweep(docs.sparkSession)
    nll = written(scores, "perplexity")
    langs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "lang").distinct()
    rows = written(
        nll.join(langs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left").drop("id", "hash"), "scored"
    )
    usual = rows.where((fold(F.col("doc_id")) == 0) & (F.col("n_words") > 0)).join(trusted, "doc_id", "left_semi")
    per_word: Column = F.sum("nll") / F.sum(F.col("n_words") + 1)
    mean_all = usual.agg(per_word).first()[0] or 0.0
    means = usual.groupBy("lang").agg(per_word.alias("mean"))

    def scored(df: DataFrame) -> DataFrame:
        held = df.alias("r").join(means.alias("m"), F.col("r.lang").eqNullSafe(F.col("m.lang")), "left")
        mean = F.coalesce("mean", F.lit(mean_all))
        score = (F.col("nll") + prior_words * mean) / (F.col("n_words") + 1 + prior_words)
        return held.select("r.*", F.when(F.col("n_words") > 0, score).alias("score"))

    calibrated = scored(usual)
    at = lambda: F.percentile_approx("score", F.lit(quantile), F.lit(10_000))
    limit_all = calibrated.agg(at()).first()[0]
    limits = calibrated.groupBy("lang").agg(at().alias("limit"))
    judged = scored(rows).alias("r").join(limits.alias("l"), F.col("r.lang").eqNullSafe(F.col("l.lang")), "left")
    threshold = F.coalesce("limit", F.lit(limit_all).cast("double"))
    return judged.select(
        "doc_id",
        "row_hash",
        F.col("r.lang").alias("lang"),
        "n_words",
        F.when(F.col("n_words") > 0, F.exp(F.col("nll") / (F.col("n_words") + 1))).alias("perplexity"),
        "score",
        threshold.alias("threshold"),
        F.coalesce((F.col("n_words") > 0) & (threshold.isNull() | (F.col("score") <= threshold)), F.lit(False)).alias("kept"),
    )
