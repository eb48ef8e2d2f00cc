"""Strict readings of text values, and the small total vocabulary of the rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casegate.functions.text import trim_padding

# The accepted spellings of a boolean. Blank means false.
TRUE_WORDS = ["TRUE", "T", "Y", "YES", "1"]
FALSE_WORDS = ["FALSE", "F", "N", "NO", "0", ""]

# What a group of attempts can collapse to.
VISION_OUTCOMES = ["NONE", "PASS", "FAIL"]

ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def boolean_word(word: Column) -> Column:
    """True, false, or null where the trimmed spelling is not in the vocabulary."""
    upper = F.upper(word)
    return F.when(upper.isin(FALSE_WORDS), F.lit(False)).when(upper.isin(TRUE_WORDS), F.lit(True))


def parse_boolean_strict(value: Column) -> Column:
    return boolean_word(trim_padding(F.coalesce(value, F.lit(""))))


def iso_day(text: Column) -> Column:
    """Trimmed ISO ``yyyy-MM-dd`` that names a real day; anything else is null."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def parse_date_strict(value: Column) -> Column:
    """Text that reads as a day as it stands, and blank text, is not trimmed first."""
    blank = F.when(value == "", F.lit(None).cast("date"))
    return blank.when(value.rlike(ISO_DATE), value.try_cast("date")).otherwise(iso_day(trim_padding(value)))


def cutoff_boundary(freeze_date: Column, months: Column | int) -> Column:
    """Freeze date minus months, clamped to the end of a shorter month."""
    count = F.lit(months) if isinstance(months, int) else months
    return F.add_months(freeze_date, -count)


def within_cutoff(last_updated: Column, boundary: Column) -> Column:
    """The boundary day itself is inside."""
    return last_updated >= boundary


def combination_key(inputs: Column) -> Column:
    """Readable key of one input combination, such as ``ciEWf:PASS``."""

    def letter(name: str, upper: str) -> Column:
        return F.when(inputs[name], F.lit(upper)).otherwise(F.lit(upper.lower()))

    return F.concat(
        letter("has_date_completed", "C"),
        letter("has_issued", "I"),
        letter("has_expired", "E"),
        letter("within_cutoff", "W"),
        letter("fee_paid", "F"),
        F.lit(":"),
        inputs["vision_outcome"],
    )


def unquote_output(value: Column) -> Column:
    """JSON-quoted output to text. The bare word ``null`` is null; ``""`` is empty."""
    text = trim_padding(value)
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return (
        F.when(value.isNull() | (value == "null"), F.lit(None).cast("string"))
        .when(quoted, F.substring(text, F.lit(2), F.length(text) - 2))
        .otherwise(text)
    )


def join_rule_ids(rule_ids: Column) -> Column:
    return F.nullif(F.array_join(rule_ids, ","), F.lit(""))


def split_permission(permission: Column) -> list[Column]:
    """``application.service.role.level`` as four columns; missing parts are null."""
    parts = F.split(permission, "\\.")
    names = ["application", "service", "role", "level"]
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]
