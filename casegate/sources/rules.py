"""Decision tables as data: the shipped baseline, XML and Parquet tables.

A rule row has one nullable column per input (null = any value), the three
outputs, its id, and its position in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.functions.text import trim_padding
from casegate.functions.values import unquote_output

INPUTS = [
    "has_date_completed",
    "has_issued",
    "has_expired",
    "within_cutoff",
    "fee_paid",
    "vision_outcome",
]
OUTPUTS = ["outcome", "target_element", "reason_code"]
RULE_COLUMNS = ["rule_id", "position", *INPUTS, *OUTPUTS]
VISION = ["NONE", "PASS", "FAIL"]

# The ids of the table's columns.
INPUT_IDS = {"in-" + name.replace("_", "-"): name for name in INPUTS}
OUTPUT_IDS = {
    "out-outcome": "outcome",
    "out-target": "target_element",
    "out-reason": "reason_code",
    "out-rule-id": "rule_id",
}

# The baseline table. Columns: id, completed, issued, expired,
# within cutoff, paid, vision outcome, outcome, target element, reason code.
BASELINE_RULES = [
    ("R1", True, None, None, None, None, None, "SKIP", None, "COMPLETED"),
    ("R2", False, True, False, None, None, None, "SKIP", None, "LIVE_PERMIT"),
    ("R3", False, True, True, None, None, None, "SKIP", None, "EXPIRED_HISTORICAL"),
    ("R4", False, False, None, False, None, None, "QUARANTINE", None, "OUT_OF_CUTOFF"),
    ("R5", False, False, None, True, False, "NONE", "MIGRATE", "vision-assessment", None),
    ("R6", False, False, None, True, False, "PASS", "MIGRATE", "cashier-fee-review", None),
    ("R7", False, False, None, True, True, "PASS", "MIGRATE", "issuing-review", None),
    ("R8", False, False, None, True, False, "FAIL", "SKIP", None, "TERMINATED_VISION_FAIL"),
]

# Our own overlapping variant: X1 repeats R2's decision, X2 contradicts R1,
# X3 sends a case to an element outside the back office.
OVERLAP_RULES = [
    *BASELINE_RULES,
    ("X1", False, True, False, None, True, None, "SKIP", None, "LIVE_PERMIT"),
    ("X2", True, None, True, None, None, None, "SKIP", None, "EXPIRED_HISTORICAL"),
    ("X3", False, False, None, True, True, "NONE", "MIGRATE", "apply-for-permit", None),
]

_LITERAL_SCHEMA = (
    "rule_id string, has_date_completed boolean, has_issued boolean, has_expired boolean, "
    "within_cutoff boolean, fee_paid boolean, vision_outcome string, outcome string, "
    "target_element string, reason_code string, position bigint"
)

_XML_SCHEMA = (
    "_id string, "
    "inputEntry array<struct<_id:string,text:string>>, "
    "outputEntry array<struct<_id:string,text:string>>"
)


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """A rule list as a literal relation, which the optimiser can size and fold."""

    def sql_value(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = ", ".join(
        "(" + ", ".join(sql_value(v) for v in (*rule, i)) + ")" for i, rule in enumerate(rules)
    )
    fields = [part.strip().split(" ") for part in _LITERAL_SCHEMA.split(",")]
    names = ", ".join(name for name, _ in fields)
    literal = spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")
    return literal.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).select(*RULE_COLUMNS)


def baseline_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, BASELINE_RULES)


def overlap_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, OVERLAP_RULES)


def _input(text: Column, name: str) -> Column:
    """An input cell: ``-`` or nothing is any value, else a boolean or one quoted word of
    the vocabulary. Any other expression fails the read, for it would match no record
    without a word."""
    cell = text.isin(*[f'"{w}"' for w in VISION]) if name == "vision_outcome" else F.lower(text).isin("true", "false")
    wrong = F.raise_error(F.concat(F.lit(f"unsupported cell in {name}: "), text)).cast("string")
    blank = text.isNull() | text.isin("-", "")
    value = F.when(~blank & cell, F.regexp_replace(text, '^"|"$', "")).when(~blank, wrong)
    return value if name == "vision_outcome" else value.cast("boolean")


def _columns(spark: SparkSession, path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Where the table's columns stand, by their ids; a table that declares no columns
    has them in the usual order."""
    schema = "input array<struct<_id:string>>, output array<struct<_id:string>>"
    declared = spark.read.option("rowTag", "decisionTable").schema(schema).xml(path)
    found = declared.select(F.col("input._id").alias("inputs"), F.col("output._id").alias("outputs")).take(2)
    if len(found) > 1:
        raise ValueError(f"{path} holds more than one decision table")
    if not found or not (found[0]["inputs"] or found[0]["outputs"]):
        return {n: i for i, n in enumerate(INPUTS)}, {n: i for i, n in enumerate([*OUTPUTS, "rule_id"])}

    def places(ids: list[str] | None, known: dict[str, str], needed: list[str]) -> dict[str, int]:
        at = {known[x]: i for i, x in enumerate(ids or []) if x in known}
        other = [x for x in ids or [] if x not in known]
        lacking = [n for n in needed if n not in at]
        if other or lacking or len(at) < len(ids or []):
            raise ValueError(f"{path}: columns unknown {other}, lacking {lacking}, or declared twice")
        return at

    return places(found[0]["inputs"], INPUT_IDS, INPUTS), places(found[0]["outputs"], OUTPUT_IDS, OUTPUTS)


def scan_rules_xml(spark: SparkSession, path: str) -> DataFrame:
    """Decision-table XML. Entries belong to the column that stands at their place, and
    columns are known by their ids, whatever their order and labels; a column with an
    unknown id, or one that is lacking, stops the read. Outputs are quoted text or the
    word ``null``; without a rule-id column the rule's own id is taken."""
    inputs, outputs = _columns(spark, path)
    raw = (
        spark.read.option("rowTag", "rule").schema(_XML_SCHEMA).xml(path)
        .withColumn("position", F.monotonically_increasing_id())
    )
    entry = lambda name: trim_padding(F.get("inputEntry", F.lit(inputs[name]))["text"])

    def output(name: str) -> Column:
        return unquote_output(trim_padding(F.get("outputEntry", F.lit(outputs[name]))["text"]))

    own = F.col("_id")
    return raw.select(
        (F.coalesce(output("rule_id"), own) if "rule_id" in outputs else own).alias("rule_id"),
        "position",
        *[_input(entry(name), name).alias(name) for name in INPUTS],
        *[output(name).alias(name) for name in OUTPUTS],
    )


def scan_rules_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A rule table in Parquet, or as CSV with a header (``kind``), columns by name in any
    order; others are ignored. CSV cells are written as in XML, with ``-`` or nothing for
    any value, and outputs with or without quotes. Rules without a ``position`` column
    keep the order of the file."""
    if kind not in ("parquet", "csv"):
        raise ValueError("rule tables are parquet or csv")
    raw = spark.read.option("header", True).option("escape", '"').csv(path) if kind == "csv" else spark.read.parquet(path)
    lacking = [c for c in ["rule_id", *INPUTS, *OUTPUTS] if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    position = F.col("position").cast("bigint") if "position" in raw.columns else F.monotonically_increasing_id()
    text = lambda name: trim_padding(F.col(name).cast("string"))

    def cell(name: str) -> Column:
        quoted = name == "vision_outcome" and ~text(name).startswith('"') & ~text(name).isin("-", "")
        return _input(F.when(quoted, F.concat(F.lit('"'), text(name), F.lit('"'))).otherwise(text(name)) if name == "vision_outcome" else text(name), name)

    def output(name: str) -> Column:
        return F.when(~text(name).isin("", "-"), unquote_output(text(name)))

    return raw.withColumn("position", position).select(
        text("rule_id").alias("rule_id"),
        "position",
        *[cell(name).alias(name) for name in INPUTS],
        *[output(name).alias(name) for name in OUTPUTS],
    )


def rules_to_xml(rules: list[tuple], inputs: list[str] | None = None, outputs: list[str] | None = None) -> str:
    """A rule list in the XML form ``scan_rules_xml`` reads, with its columns in any order."""
    inputs, outputs = inputs or INPUTS, outputs or [*OUTPUTS, "rule_id"]
    ids = {v: k for k, v in {**INPUT_IDS, **OUTPUT_IDS}.items()}

    def entry(value: object) -> str:
        if value is None:
            return "-"
        return str(value).lower() if isinstance(value, bool) else f'"{value}"'

    out = ["<definitions><decisionTable>"]
    out += [f'<input id="{ids[n]}"/>' for n in inputs] + [f'<output id="{ids[n]}"/>' for n in outputs]
    for rule in rules:
        values = dict(zip(["rule_id", *INPUTS, *OUTPUTS], rule, strict=True))
        out.append(f'<rule id="{values["rule_id"]}">')
        out += [f"<inputEntry><text>{entry(values[n])}</text></inputEntry>" for n in inputs]
        out += [
            "<outputEntry><text>" + ("null" if values[n] is None else f'"{values[n]}"') + "</text></outputEntry>"
            for n in outputs
        ]
        out.append("</rule>")
    out.append("</decisionTable></definitions>")
    return "\n".join(out)


def rule_version(rules: DataFrame) -> DataFrame:
    """One row: hash of the ordered rule rows, to bind a run to its rule table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in RULE_COLUMNS if c != "position"]
    row = F.concat_ws("|", *cells)
    return rules.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("rules_hash"),
        F.count(F.lit(1)).alias("n_rules"),
    )


def scan_model_elements(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the user tasks a process model in XML defines."""
    tasks = spark.read.option("rowTag", "userTask").schema("_id string").xml(path)
    return tasks.select(F.col("_id").alias("target_element")).distinct()
