"""Hand-written expectations per source line. The last column is free text and
may hold commas; only the first five fields count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.functions.text import blank_to_null, is_present, trim_padding
from casegate.sources.export import number_lines, read_lines
from casegate.sources.manifest import ROW_MARKER


def scan_expectations(spark: SparkSession, path: str) -> DataFrame:
    lines = number_lines(read_lines(spark, path))
    used = (
        is_present(F.col("raw"))
        & ~F.col("raw").startswith("#")
        & ~F.col("raw").startswith(ROW_MARKER)
    )
    f = F.split("raw", ",", 6)
    rows = lines.where(used).select(
        "part",
        F.col("source_line").alias("at"),
        trim_padding(F.get(f, F.lit(0))).cast("bigint").alias("source_line"),
        blank_to_null(F.get(f, F.lit(1))).alias("case_ref"),
        trim_padding(F.get(f, F.lit(2))).alias("outcome"),
        blank_to_null(F.get(f, F.lit(3))).alias("target_element"),
        blank_to_null(F.get(f, F.lit(4))).alias("reason_code"),
    )
    # A repeated line replaces the earlier one.
    return rows.groupBy("part", "source_line").agg(
        *[F.max_by(c, "at").alias(c) for c in ["case_ref", "outcome", "target_element", "reason_code"]]
    )
