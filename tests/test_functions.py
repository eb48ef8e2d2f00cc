import hashlib

import pytest
from pyspark.sql import functions as F

from casegate.functions import text, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, trimmed",
    [("\ta b \x01", "a b"), ("", ""), ("  ", ""), ("\u2003x\u2003", "\u2003x\u2003")],
)
def test_trim_padding_drops_control_characters_and_keeps_unicode_space(spark, raw, trimmed):
    assert one(spark, text.trim_padding(F.lit(raw))) == trimmed


@pytest.mark.parametrize(
    "value, present",
    [(None, False), ("", False), (" \t\x1f", False), ("\u2003", False), ("\u00a0", True), ("x", True), (" x", True)],
)
def test_is_present(spark, value, present):
    assert one(spark, text.is_present(F.lit(value).cast("string"))) is present


def test_bare_comma_split_ignores_quotes_and_keeps_trailing_fields(spark):
    assert one(spark, text.split_fields(F.lit('"a,b",c,,'))) == ['"a', 'b"', "c", "", ""]


@pytest.mark.parametrize(
    "raw", ["a,b", " a\t, b\x01 c ,", ",,", " , , ", "\x00\x1f", "", " x", "a,b\r", "\u2003,\u2003 y"]
)
def test_split_trims_every_field(spark, raw):
    padding = "".join(map(chr, range(0x21)))
    assert one(spark, text.split_fields(F.lit(raw))) == [f.strip(padding) for f in raw.split(",")]


def test_short_line_and_unknown_column_read_as_empty(spark):
    fields = text.split_fields(F.lit("a,b"))
    assert one(spark, text.field_at(fields, 5)) == ""
    assert one(spark, text.field_at(fields, None)) == ""


def test_line_hash_ignores_one_carriage_return(spark):
    expected = "sha256:" + hashlib.sha256("é,x".encode()).hexdigest()
    assert one(spark, text.line_hash(F.lit("é,x"))) == expected
    assert one(spark, text.line_hash(F.lit("é,x\r"))) == expected


def test_repeated_header_name_means_the_last_position():
    assert text.header_positions(text.header_names("A, B ,A")) == {"A": 2, "B": 1}


@pytest.mark.parametrize(
    "value, flag",
    [("TRUE", True), (" yes ", True), ("1", True), ("t", True), ("y", True), ("no", False), ("0", False),
     ("", False), (None, False), ("F", False), ("maybe", None), ("2", None), ("TRUE!", None)],
)
def test_boolean_vocabulary_is_closed(spark, value, flag):
    assert one(spark, values.parse_boolean_strict(F.lit(value).cast("string"))) is flag


@pytest.mark.parametrize(
    "value, day",
    [("2026-01-05", "2026-01-05"), (" 2026-01-05 ", "2026-01-05"), ("2026-1-5", None), ("2026", None),
     ("2026-02-30", None), ("2024-02-29", "2024-02-29"), ("2026-01-05T10", None), ("", None), (None, None)],
)
def test_only_full_iso_days_are_dates(spark, value, day):
    found = one(spark, values.parse_date_strict(F.lit(value).cast("string")))
    assert (str(found) if found else None) == day


def test_cutoff_is_clamped_to_month_end_and_inclusive(spark):
    boundary = values.cutoff_boundary(F.to_date(F.lit("2026-08-31")), 6)
    assert str(one(spark, boundary)) == "2026-02-28"
    assert one(spark, values.within_cutoff(F.to_date(F.lit("2026-02-28")), boundary)) is True
    assert one(spark, values.within_cutoff(F.to_date(F.lit("2026-02-27")), boundary)) is False


@pytest.mark.parametrize(
    "raw, plain",
    [('"MIGRATE"', "MIGRATE"), ("null", None), (None, None), ('""', ""), ("bare", "bare"), ('"', '"'), (' "x" ', "x")],
)
def test_unquote_output(spark, raw, plain):
    assert one(spark, values.unquote_output(F.lit(raw).cast("string"))) == plain


def test_split_permission_and_rule_ids(spark):
    row = spark.range(1).select(*values.split_permission(F.lit("12.4.7"))).first()
    assert tuple(row) == ("12", "4", "7", None)
    assert one(spark, values.join_rule_ids(F.array(F.lit("R1"), F.lit("R2")))) == "R1,R2"
    assert one(spark, values.join_rule_ids(F.expr("cast(array() as array<string>)"))) is None


def test_dates_and_splits_need_no_trim_where_the_text_is_clean(spark):
    cases = ["2001-02-03", "2001-02-03\n", " 2001-02-03 ", "2001-02-30", "2001-2-3", "", " ", None, "+2001-2-3", "2001-02-03T"]
    found = [one(spark, values.parse_date_strict(F.lit(c).cast("string"))) for c in cases]
    assert [str(d) if d else None for d in found] == ["2001-02-03"] * 3 + [None] * 7
    assert one(spark, text.split_fields(F.lit("a b,c , d"))) == ["a b", "c", "d"]
    assert one(spark, text.split_fields(F.lit("a b,c"))) == ["a b", "c"]
