"""The freeze manifest: run parameters, and one hash per source line.

Text layout: ``#`` comments, ``key=value`` lines, the marker line
``SOURCE_LINE,CASE_REF,SOURCE_HASH``, then rows. A folder may hold one manifest
per export part.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.functions.text import blank_to_null, is_present, split_fields, trim_padding
from casegate.functions.values import parse_date_strict
from casegate.sources.export import number_lines, read_lines

# Header keys of the manifest format and its row marker.
HEADER_KEYS = ["freezeDate", "cutoffMonths", "runId", "recordCount", "headerHash"]
ROW_MARKER = "SOURCE_LINE,"


class RunHalted(RuntimeError):
    """The run must not go on: an integrity check failed before any write."""


@dataclass(frozen=True)
class RunParameters:
    run_id: str
    freeze_date: date
    cutoff_months: int
    header_hash: str
    record_count: int


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered manifest lines with ``in_rows`` telling the two sections apart."""
    lines = number_lines(read_lines(spark, path), F.col("raw").startswith(ROW_MARKER))
    used = is_present(F.col("raw")) & ~F.col("raw").startswith("#")
    return lines.where(used & ~F.col("raw").startswith(ROW_MARKER)).select(
        "part",
        "source_line",
        "raw",
        F.coalesce(F.col("source_line") > F.col("marker_line"), F.lit(False)).alias("in_rows"),
    )


def manifest_rows(lines: DataFrame) -> DataFrame:
    """One hash per source line; of a repeated line the later row counts."""
    f = split_fields(F.col("raw"))
    rows = lines.where(F.col("in_rows") & (F.size(f) >= 3)).select(
        "part",
        F.col("source_line").alias("at"),
        trim_padding(F.get(f, F.lit(0))).cast("bigint").alias("source_line"),
        blank_to_null(F.get(f, F.lit(1))).alias("case_ref"),
        trim_padding(F.get(f, F.lit(2))).alias("source_hash"),
    )
    return rows.groupBy("part", "source_line").agg(
        F.max_by("case_ref", "at").alias("case_ref"),
        F.max_by("source_hash", "at").alias("source_hash"),
    )


def manifest_header(lines: DataFrame) -> DataFrame:
    """One row per part with the header values as text; unknown keys are ignored."""
    pairs = lines.where(~F.col("in_rows") & F.col("raw").contains("=")).select(
        "part",
        F.col("source_line").alias("at"),
        trim_padding(F.substring_index("raw", "=", 1)).alias("k"),
        trim_padding(F.expr("substring(raw, instr(raw, '=') + 1)")).alias("v"),
    )
    return pairs.groupBy("part").agg(
        *[
            F.max_by("v", F.when(F.col("k") == key, F.col("at"))).alias(key)
            for key in HEADER_KEYS
        ]
    )


def manifest_problems(header: DataFrame, rows: DataFrame) -> DataFrame:
    """Per part, what makes the manifest unusable; ``problem`` is null if nothing."""
    counted = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    n_rows = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    record_count = F.col("recordCount").try_cast("bigint")
    problem = (
        F.when(parse_date_strict(F.col("freezeDate")).isNull(), "FREEZE_DATE")
        .when(F.col("cutoffMonths").try_cast("int").isNull(), "CUTOFF_MONTHS")
        .when(~is_present(F.col("runId")), "RUN_ID")
        .when(record_count.isNull(), "RECORD_COUNT")
        .when(~is_present(F.col("headerHash")), "HEADER_HASH")
        .when(record_count != n_rows, "ROW_COUNT")
    )
    return header.join(counted, "part", "left").select(
        "part",
        F.col("runId").alias("run_id"),
        parse_date_strict(F.col("freezeDate")).alias("freeze_date"),
        F.col("cutoffMonths").try_cast("int").alias("cutoff_months"),
        record_count.alias("record_count"),
        n_rows.alias("n_rows"),
        F.col("headerHash").alias("header_hash"),
        problem.alias("problem"),
    )


def run_parameters(problems: DataFrame) -> RunParameters:
    """Parameters of the run, or a halt. Parts must agree on everything but the
    count, which adds up."""
    summary = problems.agg(
        F.count(F.lit(1)).alias("parts"),
        F.min("problem").alias("problem"),
        F.count_distinct("run_id", "freeze_date", "cutoff_months", "header_hash").alias("kinds"),
        F.max("run_id").alias("run_id"),
        F.max("freeze_date").alias("freeze_date"),
        F.max("cutoff_months").alias("cutoff_months"),
        F.max("header_hash").alias("header_hash"),
        F.sum("record_count").alias("record_count"),
    ).first()
    if summary["parts"] == 0:
        raise RunHalted("manifest has no header")
    if summary["problem"] is not None:
        raise RunHalted(f"manifest unusable: {summary['problem']}")
    if summary["kinds"] != 1:
        raise RunHalted("manifest parts disagree about the run")
    return RunParameters(
        summary["run_id"],
        summary["freeze_date"],
        summary["cutoff_months"],
        summary["header_hash"],
        summary["record_count"],
    )


def build_manifest_lines(
    records: DataFrame, headers: DataFrame, run_id: str, freeze_date: str, cutoff_months: int
) -> DataFrame:
    """Freeze step: manifest text lines ``(part, at, raw)`` for an export.
    Header values come first (negative ``at``), then rows by source line."""
    counts = headers.select("part", "header_hash").join(
        records.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left"
    )
    header = counts.select(
        "part",
        F.posexplode(
            F.array(
                F.lit(f"freezeDate={freeze_date}"),
                F.lit(f"cutoffMonths={cutoff_months}"),
                F.lit(f"runId={run_id}"),
                F.concat(F.lit("recordCount="), F.coalesce("n", F.lit(0)).cast("string")),
                F.concat(F.lit("headerHash="), F.col("header_hash")),
                F.lit("SOURCE_LINE,CASE_REF,SOURCE_HASH"),
            )
        ).alias("pos", "raw"),
    ).select("part", (F.col("pos") - 6).cast("bigint").alias("at"), "raw")
    body = records.select(
        "part",
        F.col("source_line").cast("bigint").alias("at"),
        F.concat_ws(",", F.col("source_line").cast("string"), "case_ref", "source_hash").alias("raw"),
    )
    return header.unionByName(body)
