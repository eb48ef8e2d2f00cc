"""Counts over a classification. The data is aggregated once to its distinct
patterns (a few hundred rows at most); every report is built from those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from casegate.functions.text import is_present
from casegate.functions.values import combination_key
from casegate.operators.decide import OUTCOMES
from casegate.operators.normalise import collapse_latest
from casegate.operators.validate import typed


def closed_list(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A fixed vocabulary as rows, for zero-filled counts."""
    rows = ", ".join(f"('{value}', {place})" for place, value in enumerate(values))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({name}, place)")


# What the blocks of a run count: rows of the load plan, answers to creates, and answers
# to releases. Creates that nobody answered are the commands without the answers.
LOAD_COUNTS = {
    "skipped": "action = 'RECORD_SKIP'",
    "quarantined": "action = 'RECORD_QUARANTINE'",
    "already_loaded": "action = 'ALREADY_LOADED'",
    "refused_pending": "action = 'REFUSE_PENDING'",
    "commands": "action = 'CREATE'",
}
ANSWER_COUNTS = {
    "created": "state = 'CREATED'",
    "already_existed": "state = 'PENDING_RESOLVED_EXISTS'",
    "rejected": "state = 'CREATE_FAILED'",
}
RELEASE_COUNTS = {"released": "state = 'RELEASED'", "failed": "state = 'RELEASE_FAILED'"}


def block(spark: SparkSession, section: str, counts: dict[str, int]) -> DataFrame:
    """Counts as rows of a report."""
    return spark.createDataFrame([(section, k, n) for k, n in counts.items()], "section string, key string, n bigint")


def observed(rows: DataFrame, section: str, counts: dict[str, str], write: Callable[[DataFrame], object]) -> DataFrame:
    """Write ``rows`` and count on the way, so the block of a report costs no scan of its
    own. ``write`` runs one job over the rows, with nothing that shuffles them after."""
    seen = Observation(section)
    conditions: list[Column] = [F.count_if(F.expr(c)).alias(k) for k, c in counts.items()]
    write(rows.observe(seen, *conditions))
    return block(rows.sparkSession, section, seen.get)


def patterns(classified: DataFrame) -> DataFrame:
    """Distinct (outcome, target, reason, redundancy, unmatched combination) with counts."""
    unmatched = F.when(F.col("reason_code") == "UNMATCHED", combination_key(F.col("input")))
    return classified.groupBy(
        "outcome", "target_element", "reason_code", "redundant", unmatched.alias("combination")
    ).agg(F.count(F.lit(1)).alias("n"))


def count_by_outcome(spark: SparkSession, counted: DataFrame) -> DataFrame:
    found = counted.groupBy("outcome").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    return (
        closed_list(spark, OUTCOMES, "outcome")
        .join(found, "outcome", "left")
        .select("outcome", F.coalesce("n", zero).alias("n"))
    )


def count_by_target(counted: DataFrame) -> DataFrame:
    return counted.where("target_element is not null").groupBy("target_element").agg(F.sum("n").alias("n"))


def count_by_reason(counted: DataFrame) -> DataFrame:
    return counted.where("reason_code is not null").groupBy("reason_code").agg(F.sum("n").alias("n"))


def unmatched_combinations(counted: DataFrame) -> DataFrame:
    """Combinations no rule matched, most frequent first, ties by key."""
    return (
        counted.where("combination is not null")
        .groupBy("combination")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "combination")
    )


def redundant_rule_count(counted: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return counted.agg(
        F.coalesce(F.sum(F.when(F.col("redundant"), F.col("n"))), zero).alias("n_redundant")
    )


def classification_report(spark: SparkSession, classified: DataFrame) -> DataFrame:
    """Long report ``(section, key, n)``: outcomes, targets, reasons, unmatched
    combinations, redundancy and the total, by grouping sets over the patterns."""
    counted = patterns(classified)
    columns = ["outcome", "target_element", "reason_code", "combination", "redundant"]
    sets = counted.groupingSets(
        [[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # grouping_id: a set bit marks a column that was rolled up.
    section = (
        F.when(F.col("gid") == 0b01111, "outcome")
        .when(F.col("gid") == 0b10111, "target")
        .when(F.col("gid") == 0b11011, "reason")
        .when(F.col("gid") == 0b11101, "unmatched")
        .when((F.col("gid") == 0b11110) & F.col("redundant"), "redundant")
        .when(F.col("gid") == 0b11111, "total")
    )
    key = (
        F.when(F.col("gid") == 0b11111, "records")
        .when(F.col("gid") == 0b11110, "rules")
        .otherwise(F.coalesce("outcome", "target_element", "reason_code", "combination"))
    )
    filled = sets.select(section.alias("section"), key.alias("key"), "n").where(
        "section is not null and key is not null"
    )
    wanted = closed_list(spark, OUTCOMES, "key").select(
        F.lit("outcome").alias("section"), "key", F.lit(0).cast("bigint").alias("n")
    )
    return filled.unionByName(wanted).groupBy("section", "key").agg(F.sum("n").alias("n"))


def field_patterns(records: DataFrame) -> DataFrame:
    """Counts per pattern of field emptiness, bounded by the flags' combinations."""
    attempts, fee = F.col("_attempts"), F.col("_fee")
    any_pass = F.exists(attempts, lambda a: a["result"] == "PASS")
    flags = {
        "completed": is_present(F.col("date_completed")),
        "issued": is_present(F.col("issued")),
        "expired": is_present(F.col("expired")),
        "fee": F.when(fee.isNull(), "OTHER").when(fee, "TRUE").otherwise("FALSE"),
        "attempts": F.when(F.size(attempts) >= 3, "3+").otherwise(F.size(attempts).cast("string")),
        "any_pass": any_pass,
        "latest": collapse_latest(attempts),
        "has_user": is_present(F.col("applicant_user_id")),
    }
    return typed(records).groupBy(*[c.cast("string").alias(n) for n, c in flags.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )


def field_profile(records: DataFrame, by: list[str]) -> DataFrame:
    """All subtotals over ``by``. The cube runs over the patterns, not the records."""
    cubed = field_patterns(records).cube(*by).agg(F.sum("n").alias("n"))
    return cubed.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in by], "n")


# Size of the sketches: about 0.8 % standard error of a distinct count, and about 1.3 %
# error of a quantile's rank, at any number of records.
KEY_BITS, AGE_K = 14, 200


def part_sketches(records: DataFrame, as_of: Column) -> DataFrame:
    """Per part, what a profile of keys and case ages needs: counts, a sketch of the
    durable keys, and one of the days from the last update to ``as_of``. A few kilobytes
    a part, to be stored and merged with those of other parts."""
    key = F.when(is_present(F.col("case_ref")), F.col("case_ref"))
    age = F.date_diff(as_of, F.col("_updated_day")).cast("bigint")
    rows = typed(records).select("part", key.alias("key"), age.alias("age"))
    return rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count("key").alias("n_keyed"),
        F.count("age").alias("n_aged"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        F.hll_sketch_agg("key", F.lit(KEY_BITS)).alias("keys"),
        F.kll_sketch_agg_bigint("age", F.lit(AGE_K)).alias("ages"),
    )


def key_and_age_profile(sketches: DataFrame) -> DataFrame:
    """One row over any parts: exact counts and ages' limits, the estimated number of
    different keys with the share of keyed records they make (1 is unique), and the
    estimated median and 90 % age, null without readable dates."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_records", "n_keyed", "n_aged")]
    merged = sketches.agg(
        *sums,
        F.min("min_age").alias("min_age"),
        F.max("max_age").alias("max_age"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_keys"),
        F.kll_merge_agg_bigint(F.when(F.col("n_aged") > 0, F.col("ages"))).alias("ages"),
    )
    at = lambda q: F.when(F.col("n_aged") > 0, F.kll_sketch_get_quantile_bigint("ages", F.lit(q)))
    share = F.when(F.col("n_keyed") > 0, F.col("n_keys") / F.col("n_keyed"))
    return merged.select(
        *[F.col(c) for c in ("n_records", "n_keyed", "n_aged", "min_age", "max_age", "n_keys")],
        share.alias("key_uniqueness"),
        at(0.5).alias("median_age"),
        at(0.9).alias("p90_age"),
    )


def placement_rate(classified: DataFrame, by: str) -> DataFrame:
    """Share of records placed without a human, per group."""
    placed = F.count_if(F.col("outcome") == "MIGRATE")
    return (
        classified.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), placed.alias("n_placed"))
        .withColumn("rate", F.round(F.col("n_placed") / F.col("n"), 6))
    )
