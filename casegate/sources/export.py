"""Reading a frozen text export: numbered raw lines, header discovery, and the
flattened source record.

An export is one text file, or a folder of files named ``part=<n>/...`` where
every part is a complete export with its own header. ``(part, source_line)``
identifies a record; a single file is part 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casegate.functions.text import (
    field_at,
    header_names,
    header_positions,
    is_present,
    line_hash,
    split_fields,
)
from casegate.session import broadcast_if_small, materialised, per_session, settled, tasks_for

# Columns of the export format, and the numbered-column patterns.
SCALAR_COLUMNS = {
    "case_ref": "CASE_REF",
    "isn": "ISN",
    "applicant_user_id": "APPLICANT_USER_ID",
    "applicant_name": "APPLICANT_NAME",
    "permit_category": "PERMIT_CATEGORY",
    "fee_amount": "FEE_AMOUNT",
    "last_updated": "LAST_UPDATED",
    "fee_paid": "FEE_PAID",
    "issued": "ISSUED",
    "expired": "EXPIRED",
    "date_completed": "DATE_COMPLETED",
}
ATTEMPT_DATE = r"VT_(\d+)_DATE"
ATTEMPT_RESULT = r"VT_(\d+)_RESULT"
RESTRICTION = r"RESTR_(\d+)"
PART_IN_PATH = r"part=(\d+)"

RECORD_COLUMNS = [
    "part",
    "source_line",
    "source_hash",
    "case_ref",
    "isn",
    "applicant_user_id",
    "applicant_name",
    "permit_category",
    "fee_amount",
    "last_updated",
    "fee_paid",
    "attempts",
    "restrictions",
    "issued",
    "expired",
    "date_completed",
]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the place they were read from, still unnumbered."""
    part = F.regexp_extract(F.col("_metadata.file_path"), PART_IN_PATH, 1)
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.coalesce(part.try_cast("int"), F.lit(0)).alias("part"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_mark"),
        F.col("value").alias("raw"),
    )


def block_offsets(lines: DataFrame, marker: Column | None = None) -> DataFrame:
    """Per input split: the mark of its first row and the lines before it in the
    file. With ``marker``, also the file line of the first row it is true for."""
    found = F.min(F.when(marker, F.col("row_mark"))) if marker is not None else F.lit(None)
    blocks = lines.groupBy("file", "block").agg(
        F.min("row_mark").alias("first_mark"),
        F.count(F.lit(1)).alias("n_lines"),
        found.cast("bigint").alias("marker_mark"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy("file")
    skip = F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))
    return (
        blocks.withColumn("skip", skip)
        .withColumn(
            "marker_line",
            F.min(F.col("marker_mark") - F.col("first_mark") + F.col("skip") + 1).over(whole),
        )
        .select("file", "block", "first_mark", "skip", "marker_line")
    )


def number_lines(lines: DataFrame, marker: Column | None = None) -> DataFrame:
    """1-based line numbers within each file, blank lines included.

    The lines are landed once, each with the split it was read from and its place
    there, and are counted and numbered from that table. So it does not matter how a
    later scan would split the files, nor whether they are written anew meanwhile.

    A line's row mark names the task that landed it, and a task lands whole splits, one
    after another. So offsets are looked up by task, with one hash probe however many
    splits a file has, and searched only among the splits of that task, of which there
    are at most ``maxPartitionBytes / openCostInBytes`` (32 as Spark comes). One row per
    task goes to all tasks while there are no more of them than ``BROADCAST_ROWS`` (64
    TB in splits of 128 MB); beyond, lines and offsets meet by task, at most a split's
    worth of lines under each key. A line without an offset fails the scan.
    """
    landed = materialised(lines).withColumn("task", F.shiftright("row_mark", 33))
    entry = F.struct("first_mark", "skip", "marker_line")
    offsets = materialised(
        block_offsets(landed, marker)
        .groupBy(F.shiftright("first_mark", 33).alias("task"))
        .agg(F.array_sort(F.collect_list(entry)).alias("splits"))
    )
    found = landed.join(broadcast_if_small(offsets), "task", "left")
    own = F.filter("splits", lambda split: split["first_mark"] <= F.col("row_mark"))
    at = F.when(F.size("splits") == 1, F.element_at("splits", 1)).otherwise(F.try_element_at(own, F.lit(-1)))
    lost = F.raise_error(F.concat(F.lit("line without an offset in "), "file")).cast("bigint")
    numbered = found.withColumn("at", at)
    line = F.when(F.col("at").isNull(), lost).otherwise(F.col("row_mark") - F.col("at.first_mark") + F.col("at.skip") + 1)
    columns = ["part", "file", line.alias("source_line"), "raw"]
    if marker is not None:
        columns.append(F.col("at.marker_line").alias("marker_line"))
    return numbered.select(*columns)


def read_header(spark: SparkSession, path: str) -> str:
    """First line of the export (of any one part): metadata, one row."""
    first = read_lines(spark, path).where(F.col("block") == 0).select("raw").head(1)
    if not first:
        raise ValueError(f"export is empty: {path}")
    return first[0]["raw"].removesuffix("\r")


def header_hashes(numbered: DataFrame) -> DataFrame:
    """Hash of the header line of every part."""
    return numbered.where("source_line = 1").select(
        "part", "file", F.col("raw").alias("header"), line_hash(F.col("raw")).alias("header_hash")
    )


def occurrence_columns(header: str | Sequence[str]) -> list[tuple[str, int, str]]:
    """Numbered columns a header declares: ``(group, occurrence, column)``."""
    names = header_names(header) if isinstance(header, str) else list(header)
    patterns = [
        ("attempt_date", ATTEMPT_DATE),
        ("attempt_result", ATTEMPT_RESULT),
        ("restriction", RESTRICTION),
    ]
    found = []
    for name in dict.fromkeys(names):
        for group, pattern in patterns:
            match = re.fullmatch(pattern, name)
            if match:
                found.append((group, int(match.group(1)), name))
    return sorted(found)


def discover_occurrences(headers: DataFrame) -> DataFrame:
    """The same discovery as a table, per part: group, occurrence, column name."""
    names = headers.select("part", F.explode(F.array_distinct(F.split("header", ","))).alias("name"))
    name = F.trim("name")
    rows = names.select("part", name.alias("column_name"))
    group = (
        F.when(F.col("column_name").rlike(f"^{ATTEMPT_DATE}$"), "attempt_date")
        .when(F.col("column_name").rlike(f"^{ATTEMPT_RESULT}$"), "attempt_result")
        .when(F.col("column_name").rlike(f"^{RESTRICTION}$"), "restriction")
    )
    return (
        rows.withColumn("group_name", group)
        .where(F.col("group_name").isNotNull())
        .withColumn("occurrence", F.regexp_extract("column_name", r"(\d+)", 1).cast("int"))
        .select("part", "group_name", "occurrence", "column_name")
    )


def nest_occurrences(fields: Column, header: Sequence[str]) -> Column:
    """Numbered wide columns to an ordered array of structs. An occurrence with
    neither date nor result is padding; with only one of them it is data."""
    at = header_positions(header)
    dates = {n: c for group, n, c in occurrence_columns(header) if group == "attempt_date"}
    results = {n: c for group, n, c in occurrence_columns(header) if group == "attempt_result"}
    numbers = sorted(dates.keys() | results.keys())
    if not numbers:
        return F.expr("cast(array() as array<struct<occurrence:int,date:string,result:string>>)")
    # One expression whatever the width: slots are looped over, not written out one by one.
    slots = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(at.get(dates.get(n))).cast("int").alias("d"), F.lit(at.get(results.get(n))).cast("int").alias("r"))
        for n in numbers
    ])
    # Most slots of a wide export are empty: they fall out before anything is built of them.
    used = F.filter(slots, lambda s: (F.get(fields, s["d"]) != "") | (F.get(fields, s["r"]) != ""))
    read = F.transform(
        used,
        lambda s: F.struct(
            s["n"].alias("occurrence"),
            F.coalesce(F.get(fields, s["d"]), F.lit("")).alias("date"),
            F.coalesce(F.get(fields, s["r"]), F.lit("")).alias("result"),
        ),
    )
    return F.filter(read, lambda a: is_present(a["date"]) | is_present(a["result"]))


def nest_multivalue(fields: Column, header: Sequence[str]) -> Column:
    at = header_positions(header)
    slots = [
        field_at(fields, at[name])
        for group, _, name in occurrence_columns(header)
        if group == "restriction"
    ]
    if not slots:
        return F.expr("cast(array() as array<string>)")
    return F.filter(F.array(*slots), is_present)


@per_session
def _record_columns(header: tuple[str, ...]) -> list[Column]:
    at = header_positions(header)
    f = F.col("f")
    return [
        *[field_at(f, at.get(column)).alias(name) for name, column in SCALAR_COLUMNS.items()],
        nest_occurrences(f, header).alias("attempts"),
        nest_multivalue(f, header).alias("restrictions"),
    ]


def source_records(numbered: DataFrame, header: str | Sequence[str]) -> DataFrame:
    """Numbered lines to flattened source records. The header line and blank
    lines drop out here, after every line has its number."""
    names = header_names(header) if isinstance(header, str) else list(header)
    body = numbered.where((F.col("source_line") > 1) & is_present(F.col("raw")))
    hashed = body.select("part", "source_line", line_hash(F.col("raw")).alias("source_hash"), "raw")
    # A filter on a field, or one that Spark infers from exploding the attempts, must not
    # split the line again for every field that it names.
    split = settled(hashed, {"f": split_fields(F.col("raw"))})
    wide = split.select("part", "source_line", "source_hash", *_record_columns(tuple(names)))
    return wide.select(*RECORD_COLUMNS)


def records_by_header(numbered: DataFrame) -> DataFrame:
    """Source records of an export, every part read by its own header. Lines of the
    parts that share a header are read together; there are few different ones."""
    headers = numbered.where("source_line = 1").select("file", "raw")
    kinds = sorted(row["raw"] for row in headers.select("raw").distinct().collect())
    if not kinds:
        raise ValueError("export is empty")
    if len(kinds) == 1:
        return source_records(numbered, kinds[0].removesuffix("\r"))
    frames = []
    for kind in kinds:
        files = headers.where(F.col("raw") == kind).select("file")
        frames.append(source_records(numbered.join(F.broadcast(files), "file", "left_semi"), kind.removesuffix("\r")))
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame)
    return together


def scan_export(spark: SparkSession, path: str) -> DataFrame:
    """Export folder or file to source records."""
    return records_by_header(number_lines(read_lines(spark, path)))


def write_parts(lines: DataFrame, path: str, order: str = "source_line", rows: int = 0) -> None:
    """Write ``(part, <order>, raw)`` as text, one ordered file per part. A part
    is a bounded slice by construction, and a task holds few of them: there are more
    tasks than the session asks for if the number of ``rows``, where known, needs them."""
    tasks = tasks_for(lines.sparkSession, rows)
    parts = lines.repartition(tasks, "part").sortWithinPartitions("part", order)
    parts.select("part", F.col("raw").alias("value")).write.partitionBy("part").text(path)
