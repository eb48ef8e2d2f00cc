"""Text rules of the export format: bare commas, control-character trimming,
Unicode blank tests, and hashes over the untouched line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Every character up to and including the space counts as padding.
PADDING = "".join(chr(code) for code in range(0x21))


def trim_padding(value: Column) -> Column:
    return F.btrim(value, F.lit(PADDING))


def is_present(value: Column) -> Column:
    """Not null, and at least one character that is not Unicode whitespace. Text
    that starts with a visible ASCII character is settled without the pattern."""
    return (
        F.when(value.isNull() | (value == ""), F.lit(False))
        .when(F.ascii(value).between(33, 126), F.lit(True))
        .otherwise(value.rlike(r"[^\p{javaWhitespace}]"))
    )


def blank_to_null(value: Column) -> Column:
    trimmed = trim_padding(value)
    return F.when(trimmed != "", trimmed)


def split_fields(raw: Column) -> Column:
    """Bare-comma split into trimmed fields, trailing empty ones kept; quotes mean
    nothing. Padding is rare, so it is looked for once per line and taken away
    around the commas, instead of trimming every field."""
    # Most lines hold no such character at all, which one class tells at once.
    padded = raw.rlike(r"[\x00-\x20]") & raw.rlike(r"^[\x00-\x20]|[\x00-\x20],|,[\x00-\x20]|[\x00-\x20]$")
    clean = trim_padding(F.regexp_replace(raw, r"[\x00-\x20]*,[\x00-\x20]*", ","))
    return F.split(F.when(padded, clean).otherwise(raw), ",", -1)


def field_at(fields: Column, position: int | None) -> Column:
    """One field; a short line or an unknown column reads as empty text."""
    if position is None:
        return F.lit("")
    return F.coalesce(F.get(fields, F.lit(position)), F.lit(""))


def header_names(header: str) -> list[str]:
    return [name.strip(PADDING) for name in header.split(",")]


def header_positions(names: Sequence[str]) -> dict[str, int]:
    """Name to position; of a repeated name the last position counts."""
    return {name: position for position, name in enumerate(names)}


def line_hash(raw: Column) -> Column:
    """Hash of the raw line without its line end (a stray CR is dropped)."""
    body = F.when(raw.endswith("\r"), F.regexp_replace(raw, "\r$", "")).otherwise(raw)
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def source_identity(source_line: Column, source_hash: Column) -> Column:
    return F.concat(F.lit("line:"), source_line.cast("string"), F.lit("/"), source_hash)
