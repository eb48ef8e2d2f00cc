"""Six total inputs per record: five booleans and one attempt outcome, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegate.functions.values import VISION_OUTCOMES, within_cutoff
from casegate.session import per_session, settled


def _dated(attempts: Column) -> Column:
    return F.filter(attempts, lambda a: a["day"].isNotNull())


def collapse_latest(attempts: Column) -> Column:
    """Latest typed attempt by date; on one day the higher number wins; none is
    NONE. An attempt without a day sorts first, so it only wins alone."""
    latest = F.array_max(attempts)
    return F.when(latest["day"].isNotNull(), latest["result"]).otherwise("NONE")


def collapse_first(attempts: Column) -> Column:
    return F.coalesce(F.array_min(_dated(attempts))["result"], F.lit("NONE"))


def collapse_any_pass(attempts: Column) -> Column:
    dated = _dated(attempts)
    return (
        F.when(F.exists(dated, lambda a: a["result"] == "PASS"), "PASS")
        .when(F.size(dated) > 0, "FAIL")
        .otherwise("NONE")
    )


COLLAPSE_POLICIES = {
    "latest": collapse_latest,
    "first": collapse_first,
    "any_pass": collapse_any_pass,
}


@per_session
def _fixed_inputs(policy: str) -> list[Column]:
    """Inputs that do not depend on the run. For records that passed validation a
    field that is there is readable."""
    return [
        F.col("_completed_day").isNotNull().alias("has_date_completed"),
        F.col("_issued_day").isNotNull().alias("has_issued"),
        F.col("_expired_day").isNotNull().alias("has_expired"),
        F.col("_fee").alias("fee_paid"),
        COLLAPSE_POLICIES[policy](F.col("_attempts")).alias("vision_outcome"),
    ]


def normalised_inputs(boundary: Column, policy: str = "latest") -> Column:
    completed, issued, expired, paid, outcome = _fixed_inputs(policy)
    inside = within_cutoff(F.col("_updated_day"), boundary).alias("within_cutoff")
    return F.struct(completed, issued, expired, inside, paid, outcome)


def cell_of(inputs: Column) -> Column:
    """Number 0-95 of an input combination: outcome first, then the five flags."""

    def bit(name: str, weight: int) -> Column:
        return F.when(inputs[name], F.lit(weight)).otherwise(F.lit(0))

    outcome = F.array_position(
        F.array(*[F.lit(v) for v in VISION_OUTCOMES]), inputs["vision_outcome"]
    ).cast("int") - 1
    return (
        outcome
        + bit("has_date_completed", 3)
        + bit("has_issued", 6)
        + bit("has_expired", 12)
        + bit("within_cutoff", 24)
        + bit("fee_paid", 48)
    )


@per_session
def _input_cell() -> Column:
    return cell_of(F.col("input"))


def normalise(validated: DataFrame, boundary: Column, policy: str = "latest") -> DataFrame:
    """Adds ``input`` and its ``cell`` to prevalidated records; both stay null where ``detail`` says the
    record cannot be interpreted."""
    passes = F.col("detail").isNull()
    inputs = {"input": F.when(passes, normalised_inputs(boundary, policy))}
    return settled(settled(validated, inputs), {"cell": _input_cell()})


def latest_attempt(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Long-format collapse: one row per key, the last in ``order``. Written as a
    rank-1 filter so that each map task keeps one row per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return attempts.withColumn("rank", F.row_number().over(window)).where("rank = 1").drop("rank")
