"""Export and manifest to a classification of every record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.operators.decide import (
    baseline_decisions,
    cell_decisions,
    contract_table,
    decide,
)
from casegate.operators.integrity import expectation_summary, freeze_check
from casegate.operators.normalise import normalise
from casegate.operators.validate import TYPED, prevalidate
from casegate.sources.export import (
    number_lines,
    read_lines,
    records_by_header,
)
from casegate.sources.manifest import (
    RunHalted,
    RunParameters,
    manifest_header,
    manifest_lines,
    manifest_problems,
    manifest_rows,
    run_parameters,
)
from casegate.sources.rules import baseline_rules, rule_version
from casegate.functions.values import cutoff_boundary
from casegate.session import materialised


def classify(
    records: DataFrame,
    boundary: Column,
    rules: DataFrame | None = None,
    contract: DataFrame | None = None,
    policy: str = "latest",
) -> DataFrame:
    """Source records to one placed row each. Lazy, and without a shuffle."""
    spark = records.sparkSession
    if rules is None and contract is None:
        decisions = baseline_decisions(spark)
    else:
        decisions = cell_decisions(
            baseline_rules(spark) if rules is None else rules,
            contract_table(spark) if contract is None else contract,
        )
    return decide(normalise(prevalidate(records), boundary, policy), decisions)


@dataclass(frozen=True)
class DryRun:
    parameters: RunParameters
    classified: DataFrame
    rules_hash: str


def first_problem(problems: DataFrame) -> str | None:
    """One example and the number of problems: a message, not the rows."""
    example = problems.head(1)
    return None if not example else f"{problems.count()} problem(s), such as {example[0].asDict()}"


def dry_run(
    spark: SparkSession,
    export: str,
    manifest: str,
    rules: DataFrame | None = None,
    policy: str = "latest",
) -> DryRun:
    """Check the freeze, then classify. Integrity failures stop the run before
    anything is written; failures of single records never do."""
    lines = manifest_lines(spark, manifest)
    rows = manifest_rows(lines)
    summary = manifest_problems(manifest_header(lines), rows)
    parameters = run_parameters(summary)

    # Line 1 among the problems means that the header, and so the schema, changed.
    numbered = number_lines(read_lines(spark, export))
    broken = first_problem(freeze_check(numbered, rows, summary.select("part", "header_hash")))
    if broken:
        raise RunHalted(f"export is not the frozen one: {broken}")
    records = records_by_header(numbered)

    boundary = cutoff_boundary(F.lit(parameters.freeze_date), parameters.cutoff_months)
    version = rule_version(baseline_rules(spark) if rules is None else rules).first()
    # Written once: the expectation check, the report and the load plan all read it.
    classified = materialised(classify(records, boundary, rules, policy=policy))
    return DryRun(parameters, classified, version["rules_hash"])


def halt_on_expectation(classified: DataFrame, expected: DataFrame) -> None:
    summary = expectation_summary(classified, expected).first()
    if not summary["passed"]:
        raise RunHalted(f"expectations not met: {summary.asDict()}")


def rule_change_diff(
    records: DataFrame, boundary: Column, before: DataFrame, after: DataFrame
) -> DataFrame:
    """Two rule tables over one frozen extract: the cases that move. Both tables
    are probed for the same row, so the extract is read once and never joined to
    itself."""
    spark = records.sparkSession
    contract = contract_table(spark)
    inputs = normalise(prevalidate(records), boundary).drop(*TYPED)

    def tuple_of(df: DataFrame, name: str) -> DataFrame:
        decision = F.struct("outcome", "target_element", "reason_code")
        return df.withColumn(name, decision).select(*inputs.columns, *kept, name)

    kept: list[str] = []
    first = tuple_of(decide(inputs, cell_decisions(before, contract)), "before")
    kept.append("before")
    second = decide(first, cell_decisions(after, contract)).withColumn(
        "after", F.struct("outcome", "target_element", "reason_code")
    )
    moved = second.where(~F.col("before").eqNullSafe(F.col("after")))
    return moved.select(
        "part",
        "source_line",
        "case_ref",
        *[
            F.col(f"{side}.{c}").alias(f"{side}_{c}")
            for side in ("before", "after")
            for c in ("outcome", "target_element", "reason_code")
        ],
    )
