"""Frozen-source checks: header, row hashes, missing rows, expectations, and
set comparisons between exports and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegate.functions.text import is_present, line_hash

KEY = ["part", "source_line"]


def header_verify(headers: DataFrame, header_hash: str | Column) -> DataFrame:
    """Parts whose header is not the frozen one."""
    expected = F.lit(header_hash) if isinstance(header_hash, str) else header_hash
    return headers.where(F.col("header_hash") != expected).select(
        "part", "header_hash", expected.alias("expected_hash")
    )


def manifest_verify(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Every source line against its manifest row, both ways; only problems come out."""
    source = records.select(*KEY, F.col("source_hash").alias("actual_hash"))
    manifest = rows.select(*KEY, F.col("source_hash").alias("expected_hash"))
    problem = (
        F.when(F.col("expected_hash").isNull(), "NOT_IN_MANIFEST")
        .when(F.col("actual_hash").isNull(), "NOT_IN_SOURCE")
        .when(F.col("actual_hash") != F.col("expected_hash"), "HASH_CHANGED")
    )
    return (
        source.join(manifest, KEY, "full_outer")
        .withColumn("problem", problem)
        .where("problem is not null")
        .select(*KEY, "problem", "expected_hash", "actual_hash")
    )


def freeze_check(numbered: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Header and rows against the manifest in one pass over the export. The header
    is source line 1; ``headers`` has ``part`` and its frozen ``header_hash``."""
    lines = numbered.where((F.col("source_line") == 1) | is_present(F.col("raw"))).select(
        *KEY, line_hash(F.col("raw")).alias("source_hash")
    )
    frozen_headers = headers.select(
        "part",
        F.lit(1).cast("bigint").alias("source_line"),
        F.col("header_hash").alias("source_hash"),
    )
    return manifest_verify(lines, rows.select(*KEY, "source_hash").unionByName(frozen_headers))


def manifest_missing_in_source(records: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(records.select(*KEY), KEY, "left_anti")


def expectation_pairs(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """Classification and expectation side by side, with what is missing on a side."""
    actual = classified.select(
        *KEY,
        F.col("case_ref").alias("a_case_ref"),
        F.col("outcome").alias("a_outcome"),
        F.col("target_element").alias("a_target"),
        F.col("reason_code").alias("a_reason"),
        F.lit(True).alias("has_record"),
    )
    wanted = expected.select(
        *KEY,
        F.col("case_ref").alias("e_case_ref"),
        F.col("outcome").alias("e_outcome"),
        F.col("target_element").alias("e_target"),
        F.col("reason_code").alias("e_reason"),
        F.lit(True).alias("has_expectation"),
    )
    return actual.join(wanted, KEY, "full_outer")


def expectation_diff(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per field that differs; nulls equal each other. A record without
    an expectation, or the reverse, is one row."""

    def field(name: str, expected_value: Column, actual_value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("field"),
            expected_value.alias("expected"),
            actual_value.alias("actual"),
        )

    absent = F.lit("none")
    fields = (
        F.when(F.col("has_expectation").isNull(), F.array(field("expectation", F.lit("a row"), absent)))
        .when(F.col("has_record").isNull(), F.array(field("record", F.lit("a record"), absent)))
        .otherwise(
            F.array(
                field("outcome", F.col("e_outcome"), F.col("a_outcome")),
                field("target_element", F.col("e_target"), F.col("a_target")),
                field("reason_code", F.col("e_reason"), F.col("a_reason")),
            )
        )
    )
    differing = F.filter(fields, lambda f: ~f["expected"].eqNullSafe(f["actual"]))
    case_ref = F.when(F.col("has_expectation").isNull(), F.col("a_case_ref")).otherwise(
        F.col("e_case_ref")
    )
    return expectation_pairs(classified, expected).select(
        *KEY, case_ref.alias("case_ref"), F.inline(differing)
    )


def expectation_summary(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: matched lines, and whether nothing differs."""
    pairs = expectation_pairs(classified, expected)
    both = F.col("has_record") & F.col("has_expectation")
    equal = (
        F.col("e_outcome").eqNullSafe(F.col("a_outcome"))
        & F.col("e_target").eqNullSafe(F.col("a_target"))
        & F.col("e_reason").eqNullSafe(F.col("a_reason"))
    )
    return pairs.agg(
        F.count_if(F.coalesce(both, F.lit(False))).alias("checked"),
        F.count_if(F.coalesce(both & ~equal, F.lit(False))).alias("differing"),
        F.count_if(F.col("has_expectation").isNull()).alias("without_expectation"),
        F.count_if(F.col("has_record").isNull()).alias("without_record"),
    ).withColumn(
        "passed",
        (F.col("differing") + F.col("without_expectation") + F.col("without_record")) == 0,
    )


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both counts: one shuffle, with a
    map-side combine, instead of two set differences."""
    columns = left.columns
    sides = left.select(*columns, F.lit(1).alias("side")).unionByName(
        right.select(*columns, F.lit(2).alias("side"))
    )
    return (
        sides.groupBy(*columns)
        .agg(
            F.count_if(F.col("side") == 1).alias("n_left"),
            F.count_if(F.col("side") == 2).alias("n_right"),
        )
        .where("n_left <> n_right")
    )


def canonical_form(classified: DataFrame) -> DataFrame:
    """What two sources must agree on; order, spacing and line numbers left out."""
    return classified.select(
        "case_ref",
        "outcome",
        "target_element",
        "reason_code",
        F.array_join(F.array_sort("rule_ids"), ",").alias("rules"),
    )


def export_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two exports of one file: added, removed and changed records per case
    reference. Equal rows cancel first, then surpluses pair up by count, so no
    pairs are formed within a reference."""
    surplus = multiset_diff(
        old.select("case_ref", "source_hash"), new.select("case_ref", "source_hash")
    )
    gone = F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))
    come = F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))
    per_key = surplus.groupBy("case_ref").agg(F.sum(gone).alias("gone"), F.sum(come).alias("come"))
    changed = F.least("gone", "come")
    return per_key.select(
        "case_ref",
        changed.alias("n_changed"),
        (F.col("come") - changed).alias("n_added"),
        (F.col("gone") - changed).alias("n_removed"),
    )


def partition_complete(classified: DataFrame, records: DataFrame) -> DataFrame:
    """One row that proves every record ended in exactly one of three outcomes: how
    many records have none and how many outcomes are too many. One pass over each side."""
    known = F.col("outcome").isin("MIGRATE", "SKIP", "QUARANTINE")
    sides = records.select(*KEY, F.lit(1).alias("n")).unionAll(
        classified.select(*KEY, F.when(known, -1).otherwise(0).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    return sides.groupBy(*KEY).agg(F.sum("n").alias("open")).agg(
        F.coalesce(F.sum(F.greatest("open", F.lit(0))), zero).cast("bigint").alias("n_lost"),
        F.coalesce(F.sum(F.greatest(-F.col("open"), F.lit(0))), zero).cast("bigint").alias("n_repeated"),
    )
