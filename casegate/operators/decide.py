"""The decision table as a join.

The six inputs have 96 combinations (cells). Rules are expanded to the cells
they match once, resolved per cell, and joined to the records on the cell
number: one hash probe per record, whatever the number of rules, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.functions.text import is_present
from casegate.functions.values import VISION_OUTCOMES, join_rule_ids
from casegate.operators.validate import TYPED
from casegate.session import broadcast_if_small, per_session, settled
from casegate.sources.rules import INPUTS, OUTPUTS, baseline_rules

CELLS = 96

# Outcomes, elements a case may be moved to, and the variables each needs.
OUTCOMES = ["MIGRATE", "SKIP", "QUARANTINE"]
BACK_OFFICE_TARGETS = ["vision-assessment", "cashier-fee-review", "issuing-review"]
TARGET_CONTRACT = {
    "vision-assessment": ["applicantName"],
    "cashier-fee-review": ["applicantName", "feeAmount"],
    "issuing-review": ["applicantName", "permitCategory"],
}


def cell_inputs(cell: Column) -> dict[str, Column]:
    """The inverse of the cell number: each input as a function of it."""
    flags = {
        name: (F.floor(cell / F.lit(3 * 2**i)) % 2) == 1 for i, name in enumerate(INPUTS[:5])
    }
    outcomes = F.array(*[F.lit(v) for v in VISION_OUTCOMES])
    return {**flags, "vision_outcome": F.get(outcomes, (cell % 3).cast("int"))}


def domain(spark: SparkSession) -> DataFrame:
    """All 96 input combinations."""
    cells = spark.range(0, CELLS, 1, 1).select(F.col("id").cast("int").alias("cell"))
    return cells.select("cell", *[c.alias(n) for n, c in cell_inputs(F.col("cell")).items()])


@per_session
def _matching_cells() -> Column:
    def matches(cell: Column) -> Column:
        values = cell_inputs(cell)
        tests = [F.col(n).isNull() | (F.col(n) == values[n]) for n in INPUTS]
        return reduce(lambda a, b: a & b, tests)

    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), matches)).alias("cell")


def rule_cells(rules: DataFrame) -> DataFrame:
    """One row per rule and cell it matches; a null input matches any value."""
    return rules.select("rule_id", "position", *OUTPUTS, _matching_cells())


def decision_table_join(inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every hit of every record (collect semantics); no hit keeps one null row."""
    return inputs.join(broadcast_if_small(rule_cells(rules)), "cell", "left")


def resolve_hits(hits: DataFrame) -> DataFrame:
    """Hits to one row per cell. Decisions are compared without the rule id, and
    an absent target or reason equals an absent one."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "rule_id")))
    decisions = F.collect_set(F.struct(*OUTPUTS))
    grouped = hits.groupBy("cell").agg(
        ordered.alias("ordered"), decisions.alias("decisions"), F.count("rule_id").alias("n_hits")
    )
    return grouped.select(
        "cell",
        "n_hits",
        F.transform("ordered", lambda h: h["rule_id"]).alias("rule_ids"),
        F.size("decisions").alias("n_decisions"),
        F.get("decisions", F.lit(0)).alias("decision"),
    )


def contract_table(spark: SparkSession, contract: dict[str, list[str]] = TARGET_CONTRACT) -> DataFrame:
    """The per-target contract as a literal relation ``(target_element, required)``."""
    rows = ", ".join(
        f"('{target}', array({', '.join(repr(name) for name in names)}))"
        for target, names in contract.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(target_element, required)")


def contract_lookup(decided: DataFrame, contract: DataFrame) -> DataFrame:
    """Adds the required variables of each target; an unknown target needs none."""
    joined = decided.join(broadcast_if_small(contract), "target_element", "left")
    required = F.coalesce("required", F.expr("cast(array() as array<string>)"))
    return joined.withColumn("required", required).withColumn(
        "required_bits", required_bits(F.col("required"))
    )


def available_variables() -> Column:
    return F.create_map(
        F.lit("applicantName"), F.col("applicant_name"),
        F.lit("permitCategory"), F.col("permit_category"),
        F.lit("feeAmount"), F.col("fee_amount"),
        F.lit("legacyStarterId"), F.col("applicant_user_id"),
    )


# Variables a record can offer, each with a bit. A contract naming anything else
# can never be met, which is the last bit.
OFFERED = {
    "applicantName": "applicant_name",
    "permitCategory": "permit_category",
    "feeAmount": "fee_amount",
    "legacyStarterId": "applicant_user_id",
}
UNKNOWN_BIT = 1 << len(OFFERED)


def required_bits(required: Column) -> Column:
    """The contract of a target as bits; evaluated per cell, not per record."""
    known = [
        F.when(F.array_contains(required, name), 1 << i).otherwise(0)
        for i, name in enumerate(OFFERED)
    ]
    unknown = F.size(F.array_except(required, F.array(*[F.lit(n) for n in OFFERED]))) > 0
    return reduce(lambda a, b: a + b, known) + F.when(unknown, UNKNOWN_BIT).otherwise(0)


def missing_bits() -> Column:
    """Which of its variables a record leaves blank."""
    blank = [F.when(is_present(F.col(c)), 0).otherwise(1 << i) for i, c in enumerate(OFFERED.values())]
    return reduce(lambda a, b: a + b, blank) + UNKNOWN_BIT


def contract_unsatisfied(bits: Column) -> Column:
    return bits.bitwiseAND(missing_bits()) != 0


def target_variables(required: Column, available: Column) -> Column:
    return F.map_filter(available, lambda name, _: F.array_contains(required, name))


def create_payload(run_id: Column | str) -> Column:
    """Variables of the create command. A contract variable replaces a base
    variable of the same name, so the later value counts."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    base = F.create_map(
        F.lit("legacyId"), F.col("case_ref"),
        F.lit("runId"), run,
        F.lit("targetElementId"), F.col("target_element"),
        F.lit("legacyStarterId"), F.col("applicant_user_id"),
    )
    extra = F.col("target_variables")
    kept = F.map_filter(base, lambda name, _: ~F.map_contains_key(extra, name))
    return F.map_concat(kept, extra)


def null_outcome_rules(rules: DataFrame) -> DataFrame:
    """Rules whose outcome is absent or unknown: a broken table, not broken data."""
    return rules.where(F.col("outcome").isNull() | ~F.col("outcome").isin(OUTCOMES))


def cell_decisions(rules: DataFrame, contract: DataFrame) -> DataFrame:
    """Everything the table says about each cell it covers: at most 96 rows."""
    resolved = resolve_hits(rule_cells(rules)).withColumn(
        "target_element", F.col("decision.target_element")
    )
    return contract_lookup(resolved, contract).drop("target_element")


@per_session
def baseline_decisions(spark: SparkSession) -> DataFrame:
    """The baseline table under the standard contract."""
    return cell_decisions(baseline_rules(spark), contract_table(spark))


@per_session
def _verdict() -> Column:
    """Why a record does not simply get its rules' decision, in a fixed order of
    checks: readable, matched, unambiguous, known outcome (else the run stops),
    allowed target, contract. Null where the decision stands."""
    outcome, target = F.col("decision.outcome"), F.col("decision.target_element")
    migrates = outcome == "MIGRATE"
    # Not allowed, or not there at all.
    bad_target = ~F.coalesce(target.isin(BACK_OFFICE_TARGETS), F.lit(False))
    unknown = ~F.coalesce(outcome.isin(OUTCOMES), F.lit(False))
    broken = F.raise_error(F.lit("decision table returned no known outcome")).cast("string")
    return (
        F.when(F.col("detail").isNotNull(), "PREVALIDATION")
        .when(F.col("n_hits").isNull(), "UNMATCHED")
        .when(F.col("n_decisions") > 1, "AMBIGUOUS")
        .when(unknown, broken)
        .when(migrates & bad_target, "CITIZEN_TARGET")
        .when(migrates & contract_unsatisfied(F.col("required_bits")), "CONTRACT_UNSATISFIED")
    )


@per_session
def _placement() -> list[Column]:
    decision = F.col("decision")
    accepted = F.col("verdict").isNull()
    migrates = decision["outcome"] == "MIGRATE"
    variables = target_variables(F.col("required"), available_variables())
    return [
        F.when(accepted, decision["outcome"]).otherwise("QUARANTINE").alias("outcome"),
        F.when(accepted, decision["target_element"]).alias("target_element"),
        F.coalesce("verdict", decision["reason_code"]).alias("reason_code"),
        F.coalesce("rule_ids", F.expr("cast(array() as array<string>)")).alias("rule_ids"),
        (accepted & (F.col("n_hits") > 1)).alias("redundant"),
        F.when(accepted & migrates, variables)
        .otherwise(F.expr("cast(map() as map<string,string>)"))
        .alias("target_variables"),
    ]


def decide(normalised: DataFrame, decisions: DataFrame) -> DataFrame:
    """Place every record, and drop the readings only the rules needed."""
    # At most one row per cell, so never more than 96.
    joined = normalised.join(F.broadcast(decisions), "cell", "left")
    judged = settled(joined, {"verdict": _verdict()})
    kept = [c for c in normalised.columns if c not in ("cell", *TYPED)]
    return judged.select(*kept, "cell", *_placement())


def domain_coverage(spark: SparkSession, rules: DataFrame, observed: DataFrame) -> DataFrame:
    """Every cell with its hits and the records that fall into it. ``observed`` is
    any frame with a ``cell`` column; it is counted before it is joined."""
    hits = resolve_hits(rule_cells(rules))
    seen = observed.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n_records"))
    n_hits = F.coalesce("n_hits", F.lit(0))
    n_decisions = F.coalesce("n_decisions", F.lit(0))
    contradiction = (F.col("has_expired") | F.col("has_date_completed")) & ~F.col("has_issued")
    return (
        domain(spark)
        .join(F.broadcast(hits), "cell", "left")
        .join(F.broadcast(seen), "cell", "left")
        .select(
            "cell",
            *INPUTS,
            n_hits.cast("bigint").alias("n_hits"),
            join_rule_ids(F.col("rule_ids")).alias("rule_ids"),
            F.when(n_hits == 0, "UNCOVERED")
            .when(n_decisions > 1, "AMBIGUOUS")
            .when(n_hits > 1, "REDUNDANT")
            .otherwise("COVERED")
            .alias("coverage"),
            (~contradiction).alias("reachable"),
            F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"),
        )
    )


def rule_usage(rules: DataFrame, observed: DataFrame) -> DataFrame:
    """Per rule: cells it matches, and observed records it fired for."""
    seen = observed.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n_records"))
    fired = rule_cells(rules).join(F.broadcast(seen), "cell", "left")
    per_rule = fired.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records")
    )
    counted = rules.join(per_rule, "rule_id", "left")
    zero = F.lit(0).cast("bigint")
    return counted.select(
        *rules.columns,
        F.coalesce("n_cells", zero).alias("n_cells"),
        F.coalesce("n_records", zero).alias("n_records"),
    )
