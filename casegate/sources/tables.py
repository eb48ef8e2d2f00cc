"""Parquet-backed tables: the append-only ledger, the run table, instance
snapshots and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER_EVENT_COLUMNS = {
    "run_id": "string",
    "part": "int",
    "source_line": "bigint",
    "kind": "string",
    "source_hash": "string",
    "case_ref": "string",
    "state": "string",
    "target_element": "string",
    "reason_code": "string",
    "rule_ids": "string",
    "detail": "string",
    "instance_key": "bigint",
    "seq": "bigint",
}

LEDGER_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LEDGER_EVENT_COLUMNS.items())


def ledger_events(df: DataFrame) -> DataFrame:
    """Bring any event frame to the full event schema; missing columns are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in LEDGER_EVENT_COLUMNS.items()
        ]
    )


def append_ledger(events: DataFrame, path: str) -> None:
    """Append events under ``run_id=<id>/``, without a commit. Events appended twice
    change nothing in their fold but ``n_events``."""
    ledger_events(events).write.mode("append").partitionBy("run_id").parquet(path)


def read_ledger(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    events = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return events.where(F.col("run_id") == run_id) if run_id is not None else events


def read_engine_snapshot(
    spark: SparkSession, path: str, process_id: str | None = None, state: str | None = "ACTIVE"
) -> DataFrame:
    """Exported instance table, filtered in the scan by process and state."""
    snapshot = spark.read.parquet(path)
    if process_id is not None:
        snapshot = snapshot.where(F.col("process_id") == process_id)
    return snapshot.where(F.col("state") == state) if state is not None else snapshot


def append_report(report: DataFrame, path: str, run_id: str, block: str = "classification", attempt: int = 0) -> None:
    """Keep a block of counts, ``(section, key, n)``, under its run; of blocks of one
    name the largest ``attempt`` is the last."""
    marks = {"run_id": F.lit(run_id), "block": F.lit(block), "attempt": F.lit(attempt).cast("bigint")}
    report.withColumns(marks).write.mode("append").partitionBy("run_id").parquet(path)
