"""Row rules that stop a record before it reaches the decision table.

Rules are ordered and the first failure is the one reported, as a short code
with the offending value. A failing row stays in the frame: nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegate.functions.text import is_present, trim_padding
from casegate.functions.values import parse_boolean_strict, parse_date_strict
from casegate.session import per_session, settled

# Typed readings of a record's text fields, made once and used by the rules and
# by normalisation. Records from tables may be untrimmed or null; null reads as blank.
TYPED = ["_updated_day", "_fee", "_issued_day", "_expired_day", "_completed_day", "_attempts"]

# What an attempt may end in.
RESULTS = ["PASS", "FAIL"]


@per_session
def _typed_columns() -> dict[str, Column]:
    attempts = F.transform(
        "attempts",
        lambda a: F.struct(
            parse_date_strict(a["date"]).alias("day"),
            a["occurrence"].alias("occurrence"),
            F.when(a["result"].isin(RESULTS), a["result"])
            .otherwise(F.upper(trim_padding(F.coalesce(a["result"], F.lit("")))))
            .alias("result"),
        ),
    )
    columns = [
        parse_date_strict(F.col("last_updated")),
        parse_boolean_strict(F.col("fee_paid")),
        parse_date_strict(F.col("issued")),
        parse_date_strict(F.col("expired")),
        parse_date_strict(F.col("date_completed")),
        attempts,
    ]
    return dict(zip(TYPED, columns))


def typed(records: DataFrame) -> DataFrame:
    """Adds the typed readings; null means absent or unreadable. Attempts are looped over,
    for which Spark has no generated code, so they are read apart from the others."""
    columns = dict(_typed_columns())
    attempts = columns.pop("_attempts")
    return settled(settled(records, columns), {"_attempts": attempts})


def missing_key() -> Column:
    return F.when(~is_present(F.col("case_ref")), F.lit("MISSING_KEY"))


def missing_user() -> Column:
    return F.when(~is_present(F.col("applicant_user_id")), F.lit("MISSING_USER"))


def bad_last_updated() -> Column:
    """Missing and unreadable are told apart; neither ever defaults."""
    value = F.col("last_updated")
    return F.when(
        F.col("_updated_day").isNull(),
        F.when(
            is_present(value), F.concat(F.lit("LAST_UPDATED_UNPARSEABLE:"), value)
        ).otherwise("LAST_UPDATED_MISSING"),
    )


def bad_boolean() -> Column:
    return F.when(
        F.col("_fee").isNull(), F.concat(F.lit("FEE_PAID_UNRECOGNISED:"), F.col("fee_paid"))
    )


def bad_dates() -> Column:
    def check(name: str, day: str) -> Column:
        wrong = F.col(day).isNull() & is_present(F.col(name))
        return F.when(wrong, F.concat(F.lit("DATE_UNPARSEABLE:"), F.col(name)))

    return F.coalesce(
        check("issued", "_issued_day"),
        check("expired", "_expired_day"),
        check("date_completed", "_completed_day"),
    )


def bad_occurrence() -> Column:
    """First bad attempt; within one attempt the result is looked at first. The
    message is only built for a record that has one."""

    def bad_result(a: Column) -> Column:
        return ~a["result"].isin(RESULTS)

    def bad(a: Column) -> Column:
        return a["day"].isNull() | bad_result(a)

    def message(typed_one: Column, text: Column) -> Column:
        at = typed_one["occurrence"].cast("string")
        return F.when(
            bad_result(typed_one), F.concat(F.lit("ATTEMPT_RESULT:"), at, F.lit(":"), F.coalesce(text["result"], F.lit("")))
        ).otherwise(F.concat(F.lit("ATTEMPT_DATE:"), at, F.lit(":"), F.coalesce(text["date"], F.lit(""))))

    first = F.get(F.filter("_attempts", bad), F.lit(0))
    same = F.filter("attempts", lambda a: a["occurrence"] == first["occurrence"])
    return F.when(F.exists("_attempts", bad), message(first, F.get(same, F.lit(0))))


def contradictions() -> Column:
    issued = is_present(F.col("issued"))
    return F.when(is_present(F.col("expired")) & ~issued, F.lit("EXPIRED_WITHOUT_ISSUED")).when(
        is_present(F.col("date_completed")) & ~issued, F.lit("COMPLETED_WITHOUT_ISSUED")
    )


RULES = {
    "rule_missing_key": missing_key,
    "rule_missing_user": missing_user,
    "rule_last_updated": bad_last_updated,
    "rule_bad_boolean": bad_boolean,
    "rule_bad_dates": bad_dates,
    "rule_bad_occurrence": bad_occurrence,
    "rule_contradictions": contradictions,
}


@per_session
def _first_failure() -> Column:
    """The rules in order, with that of the attempts as it was read."""
    return F.coalesce(*[F.col("_occurrence") if name == "rule_bad_occurrence" else rule() for name, rule in RULES.items()])


@per_session
def _occurrence_failure() -> Column:
    return bad_occurrence()


def prevalidate(records: DataFrame) -> DataFrame:
    """Adds ``detail``: the first failing rule, or null for a record that passes. The rule
    of the attempts loops, and is kept apart from what generated code can do."""
    looped = settled(typed(records), {"_occurrence": _occurrence_failure()})
    return settled(looped, {"detail": _first_failure()}).drop("_occurrence")


def check_rule(records: DataFrame, rule: str) -> DataFrame:
    """Records one rule stops, with its message."""
    return settled(typed(records), {"detail": RULES[rule]()}).where("detail is not null")


def duplicate_keys(records: DataFrame) -> DataFrame:
    """Case references used by more than one record. Counted with a map-side
    combine; blank references are the missing-key rule's business."""
    return (
        records.where(is_present(F.col("case_ref")))
        .groupBy("case_ref")
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where("n_records > 1")
    )


def records_with_duplicate_key(records: DataFrame) -> DataFrame:
    """Opt-in rule: every record that shares its case reference with another."""
    return records.join(duplicate_keys(records).select("case_ref"), "case_ref", "left_semi")


def truncated_groups(records: DataFrame, declared: Column) -> DataFrame:
    """Records whose independently declared attempt count exceeds what arrived."""
    return records.withColumn("declared", declared).where(
        F.col("declared") > F.size("attempts")
    )
