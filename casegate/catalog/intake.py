"""Queries over scans, text fields and row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.catalog import bindings as b
from casegate.catalog import oracle as o
from casegate.catalog.registry import query
from casegate.functions import text, values
from casegate.operators import decide, normalise, validate
from casegate.sources import expectations, export, manifest, rules

HEADER_SQL = o.HEADER_SQL
HEADER_HASH_SQL = f"'sha256:' || sha256({HEADER_SQL})"
PARTS_SQL = f"SELECT DISTINCT CAST(o_orderkey // {b.PART_ROWS} AS INT) AS part FROM orders"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return export.number_lines(export.read_lines(spark, b.export_path(spark, sf)))


@query(
    "scan_export_lines",
    f"{o.WITH_CASES} SELECT part, sha256(raw) AS line_hash, count(*) AS n FROM "
    f"(SELECT part, raw FROM rec UNION ALL SELECT part, {HEADER_SQL} FROM ({PARTS_SQL})) GROUP BY ALL",
)
def scan_export_lines(spark, sf):
    lines = export.read_lines(spark, b.export_path(spark, sf))
    return lines.groupBy("part", F.sha2("raw", 256).alias("line_hash")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_line_number",
    f"{o.WITH_CASES} SELECT part, 1 + row_number() OVER (PARTITION BY part ORDER BY k) AS source_line, raw FROM rec "
    f"UNION ALL SELECT part, 1, {HEADER_SQL} FROM ({PARTS_SQL})",
)
def source_line_number(spark, sf):
    return _numbered(spark, sf).select("part", "source_line", "raw")


@query(
    "discover_occurrence_columns",
    f"""WITH names AS (SELECT part, unnest(string_split({HEADER_SQL}, ',')) AS column_name FROM ({PARTS_SQL})),
    grouped AS (SELECT *, CASE WHEN regexp_full_match(column_name, 'VT_[0-9]+_DATE') THEN 'attempt_date'
      WHEN regexp_full_match(column_name, 'VT_[0-9]+_RESULT') THEN 'attempt_result'
      WHEN regexp_full_match(column_name, 'RESTR_[0-9]+') THEN 'restriction' END AS group_name FROM names)
    SELECT part, group_name, CAST(regexp_extract(column_name, '([0-9]+)', 1) AS INT) AS occurrence, column_name
    FROM grouped WHERE group_name IS NOT NULL""",
)
def discover_occurrence_columns(spark, sf):
    return export.discover_occurrences(export.header_hashes(_numbered(spark, sf)))


# The planted manifest: rows left out, wrong hashes, and rows without a line.
MANIFEST_SQL = f"""
manifest AS (
  SELECT part, source_line, nullif(case_ref, '') AS case_ref,
    CASE WHEN k % 131 = 0 THEN 'sha256:' || sha256(case_ref) ELSE source_hash END AS source_hash
  FROM rec WHERE k % 127 <> 0
  UNION ALL
  SELECT part, source_line + 500000000, nullif(case_ref, ''),
    CASE WHEN k % 131 = 0 THEN 'sha256:' || sha256(case_ref) ELSE source_hash END
  FROM rec WHERE k % 127 <> 0 AND k % 137 = 0)"""
WITH_MANIFEST = f"{o.WITH_CASES},{MANIFEST_SQL}"


def _manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.manifest_lines(spark, b.manifest_path(spark, sf))


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.manifest_rows(_manifest_lines(spark, sf))


@query("scan_manifest", f"{WITH_MANIFEST} SELECT part, source_line, case_ref, source_hash FROM manifest")
def scan_manifest(spark, sf):
    return manifest_rows(spark, sf).select("part", "source_line", "case_ref", "source_hash")


@query(
    "manifest_required",
    f"{WITH_MANIFEST} SELECT part, '{b.RUN_ID}' AS run_id, '{b.FREEZE_DATE}' AS freeze_date, "
    f"{b.CUTOFF_MONTHS} AS cutoff_months, count(*) AS record_count, count(*) AS n_rows, "
    f"{HEADER_HASH_SQL} AS header_hash, CAST(NULL AS VARCHAR) AS problem FROM manifest GROUP BY part",
)
def manifest_required(spark, sf):
    lines = _manifest_lines(spark, sf)
    problems = manifest.manifest_problems(manifest.manifest_header(lines), manifest.manifest_rows(lines))
    return problems.withColumn("freeze_date", F.col("freeze_date").cast("string"))


# The planted expectations: some differ, some are missing, some are invented.
EXPECTED_SQL = """
expected AS (
  SELECT part, source_line, nullif(case_ref, '') AS case_ref,
    CASE WHEN k % 37 = 0 THEN 'SKIP' ELSE outcome END AS outcome, target_element, reason_code
  FROM classified WHERE k % 41 <> 0
  UNION ALL
  SELECT part, source_line + 500000000, nullif(case_ref, ''),
    CASE WHEN k % 37 = 0 THEN 'SKIP' ELSE outcome END, target_element, reason_code
  FROM classified WHERE k % 41 <> 0 AND k % 43 = 0)"""
WITH_EXPECTED = f"{o.WITH_CLASSIFIED},{EXPECTED_SQL}"


def expected(spark: SparkSession, sf: str) -> DataFrame:
    return expectations.scan_expectations(spark, b.expectations_path(spark, sf))


@query("scan_expectations", f"{WITH_EXPECTED} SELECT * FROM expected")
def scan_expectations(spark, sf):
    return expected(spark, sf)


OBSERVED_RULES_SQL = f"""
fired AS (SELECT rule_id, count(*) AS n_records FROM hits GROUP BY rule_id),
cells AS (SELECT (c // 3) % 2 = 1 AS i_c, (c // 6) % 2 = 1 AS i_i, (c // 12) % 2 = 1 AS i_e, (c // 24) % 2 = 1 AS i_w,
    (c // 48) % 2 = 1 AS i_f, ['NONE', 'PASS', 'FAIL'][(c % 3) + 1] AS i_v, CAST(c AS INT) AS cell FROM range(96) t(c)),
cell_hits AS (SELECT cell, rule_id, position, r.outcome AS outcome, r.target_element, r.reason_code FROM cells JOIN rules r ON {o.MATCH}),
n_cells AS (SELECT rule_id, count(*) AS n_cells FROM cell_hits GROUP BY rule_id)"""


def rules_xml_path(spark: SparkSession, sf: str) -> str:
    def write(path: str) -> None:
        xml = rules.rules_to_xml(rules.OVERLAP_RULES, rules.INPUTS[::-1], ["rule_id", *rules.OUTPUTS[::-1]])
        spark.range(0, 1, 1, 1).select(F.lit(xml).alias("value")).write.text(path)

    return b.written(spark, sf, "rules-xml", write)


@query(
    "scan_rules",
    f"{o.WITH_OVERLAP},{OBSERVED_RULES_SQL} SELECT rules.rule_id, has_date_completed, has_issued, has_expired, "
    "within_cutoff, fee_paid, vision_outcome, outcome, target_element, reason_code, "
    "coalesce(n_cells, 0) AS n_cells, coalesce(n_records, 0) AS n_records "
    "FROM rules LEFT JOIN fired USING (rule_id) LEFT JOIN n_cells USING (rule_id)",
)
def scan_rules(spark, sf):
    """Rules read from XML, each with the cells it matches and the cases it fires for."""
    inputs = normalise.normalise(validate.prevalidate(b.cases(spark, sf)), b.boundary())
    table = rules.scan_rules_xml(spark, rules_xml_path(spark, sf))
    return decide.rule_usage(table, inputs).drop("position")


@query(
    "bind_rule_version",
    f"{o.WITH_CASES}, rules AS ({o.rules_values(rules.BASELINE_RULES)}), "
    "version AS (SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS rules_hash, count(*) AS n_rules FROM "
    "(SELECT concat_ws('|', "
    + ", ".join(f"coalesce(CAST({n} AS VARCHAR), '-')" for n in o.RULE_NAMES[:-1])
    + ") AS line FROM rules)) "
    f"SELECT '{b.RUN_ID}' AS run_id, count(*) AS record_count, any_value(rules_hash) AS rules_hash, "
    "any_value(n_rules) AS n_rules FROM rec, version",
)
def bind_rule_version(spark, sf):
    """The run row with the hash of the rule table it was classified with."""
    version = rules.rule_version(rules.baseline_rules(spark)).first()
    return b.cases(spark, sf).agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(b.RUN_ID).alias("run_id"),
        "record_count",
        F.lit(version["rules_hash"]).alias("rules_hash"),
        F.lit(version["n_rules"]).alias("n_rules"),
    )


@query("header_hash", f"SELECT part, {HEADER_HASH_SQL} AS header_hash FROM ({PARTS_SQL})")
def header_hash(spark, sf):
    return export.header_hashes(_numbered(spark, sf)).select("part", "header_hash")


# ---- fields ----------------------------------------------------------------

SCALARS = list(export.SCALAR_COLUMNS)


@query("split_fields", f"{o.WITH_CASES} SELECT part, source_line, {', '.join(SCALARS)} FROM rec")
def split_fields(spark, sf):
    """From the text export, so short lines and numbering are part of it."""
    return export.scan_export(spark, b.export_path(spark, sf)).select("part", "source_line", *SCALARS)


@query("row_hash", f"{o.WITH_CASES} SELECT part, source_line, source_hash FROM rec")
def row_hash(spark, sf):
    return b.cases(spark, sf).select("part", "source_line", "source_hash")


@query(
    "source_identity",
    f"{o.WITH_CASES} SELECT 'line:' || source_line || '/' || source_hash AS source_identity FROM rec",
)
def source_identity(spark, sf):
    identity = text.source_identity(F.col("source_line"), F.col("source_hash"))
    return b.cases(spark, sf).select(identity.alias("source_identity"))


@query(
    "nest_occurrences",
    f"{o.WITH_CASES} SELECT part, source_line, n AS occurrence, d AS date, r AS result FROM ("
    + " UNION ALL ".join(
        f"SELECT part, source_line, {n} AS n, vt_{n}_date AS d, vt_{n}_result AS r FROM rec" for n in o.SLOTS
    )
    + ") WHERE d <> '' OR r <> ''",
)
def nest_occurrences(spark, sf):
    return b.cases(spark, sf).select("part", "source_line", F.inline("attempts"))


@query(
    "nest_multivalue",
    f"{o.WITH_CASES} SELECT part, source_line, CAST((restr_1 <> '') AS INT) + CAST((restr_2 <> '') AS INT) + CAST((restr_3 <> '') AS INT) AS n, "
    "concat_ws(',', nullif(restr_1, ''), nullif(restr_2, ''), nullif(restr_3, '')) AS restrictions FROM rec",
)
def nest_multivalue(spark, sf):
    return b.cases(spark, sf).select(
        "part",
        "source_line",
        F.size("restrictions").alias("n"),
        F.array_join("restrictions", ",").alias("restrictions"),
    )


@query(
    "is_present",
    f"{o.WITH_CASES} SELECT part, source_line, "
    + ", ".join(f"{c} <> '' AS has_{c}" for c in SCALARS)
    + " FROM rec",
)
def is_present(spark, sf):
    flags = [text.is_present(F.col(c)).alias(f"has_{c}") for c in SCALARS]
    return b.cases(spark, sf).select("part", "source_line", *flags)


@query(
    "parse_boolean_strict",
    f"{o.WITH_CASES} SELECT part, source_line, fee_paid, {o.flag('fee_paid')} AS flag FROM rec",
)
def parse_boolean_strict(spark, sf):
    flag = values.parse_boolean_strict(F.col("fee_paid"))
    return b.cases(spark, sf).select("part", "source_line", "fee_paid", flag.alias("flag"))


_date_fields = ["last_updated", "issued", "expired", "date_completed"]


@query(
    "parse_date_strict",
    f"{o.WITH_CASES} SELECT part, source_line, "
    + ", ".join(f"CAST({o.day(c)} AS VARCHAR) AS {c}" for c in _date_fields)
    + " FROM rec",
)
def parse_date_strict(spark, sf):
    days = [values.parse_date_strict(F.col(c)).cast("string").alias(c) for c in _date_fields]
    return b.cases(spark, sf).select("part", "source_line", *days)


_MONTHS = [0, 1, 6, 36]


@query(
    "cutoff_boundary",
    "SELECT o_orderkey, "
    + ", ".join(
        f"strftime(CAST(o_orderdate AS DATE) - INTERVAL {m} MONTH, '%Y-%m-%d') AS minus_{m}" for m in _MONTHS
    )
    + " FROM orders",
)
def cutoff_boundary(spark, sf):
    """Every order date as a freeze date, with several cutoffs: month ends included."""
    freeze = F.to_date("o_orderdate")
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        *[values.cutoff_boundary(freeze, m).cast("string").alias(f"minus_{m}") for m in _MONTHS],
    )


@query(
    "within_cutoff",
    f"{o.WITH_CASES} SELECT part, source_line, {o.day('last_updated')} >= {o.BOUNDARY} AS within_cutoff FROM rec",
)
def within_cutoff(spark, sf):
    inside = values.within_cutoff(values.parse_date_strict(F.col("last_updated")), b.boundary())
    return b.cases(spark, sf).select("part", "source_line", inside.alias("within_cutoff"))


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.normalise(validate.prevalidate(b.cases(spark, sf)), b.boundary())


@query(
    "normalise_inputs",
    f"{o.WITH_INPUTS} SELECT part, source_line, i_c AS has_date_completed, i_i AS has_issued, i_e AS has_expired, "
    "i_w AS within_cutoff, i_f AS fee_paid, i_v AS vision_outcome, cell FROM keyed WHERE ok",
)
def normalise_inputs(spark, sf):
    return inputs(spark, sf).where("detail is null").select("part", "source_line", "input.*", "cell")


@query("combination_key", f"{o.WITH_INPUTS} SELECT combination, count(*) AS n FROM keyed WHERE ok GROUP BY ALL")
def combination_key(spark, sf):
    key = values.combination_key(F.col("input"))
    return inputs(spark, sf).where("detail is null").groupBy(key.alias("combination")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "unquote_output",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, outcome, target_element, reason_code, '' AS empty FROM classified",
)
def unquote_output(spark, sf):
    """Outputs as a decision engine encodes them, decoded again."""

    def encoded(c: str):
        return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))

    names = ["outcome", "target_element", "reason_code"]
    raw = b.classified(spark, sf).select("part", "source_line", *[encoded(c).alias(c) for c in names])
    return raw.select(
        "part",
        "source_line",
        *[values.unquote_output(F.col(c)).alias(c) for c in names],
        values.unquote_output(F.concat(F.lit('"'), F.lit('"'))).alias("empty"),
    )


def _map_text(column) -> F.Column:
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(
    "available_variables",
    f"{o.WITH_CASES} SELECT part, source_line, 'applicantName=' || applicant_name || ';feeAmount=' || fee_amount || "
    "';legacyStarterId=' || applicant_user_id || ';permitCategory=' || permit_category AS variables FROM rec",
)
def available_variables(spark, sf):
    variables = _map_text(decide.available_variables()).alias("variables")
    return b.cases(spark, sf).select("part", "source_line", variables)


_target_variables_sql = (
    "concat_ws(';', CASE WHEN target_element IS NOT NULL THEN 'applicantName=' || applicant_name END, "
    "CASE WHEN target_element = 'cashier-fee-review' THEN 'feeAmount=' || fee_amount END, "
    "CASE WHEN target_element = 'issuing-review' THEN 'permitCategory=' || permit_category END)"
)


@query(
    "target_variables",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, target_element, {_target_variables_sql} AS variables "
    "FROM classified WHERE outcome = 'MIGRATE'",
)
def target_variables(spark, sf):
    rows = b.classified(spark, sf).where("outcome = 'MIGRATE'")
    return rows.select(
        "part", "source_line", "target_element", _map_text(F.col("target_variables")).alias("variables")
    )


@query(
    "create_payload",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, concat_ws(';', 'applicantName=' || applicant_name, "
    "CASE WHEN target_element = 'cashier-fee-review' THEN 'feeAmount=' || fee_amount END, "
    "'legacyId=' || case_ref, 'legacyStarterId=' || applicant_user_id, "
    "CASE WHEN target_element = 'issuing-review' THEN 'permitCategory=' || permit_category END, "
    f"'runId={b.RUN_ID}', 'targetElementId=' || target_element) AS payload "
    "FROM classified WHERE outcome = 'MIGRATE'",
)
def create_payload(spark, sf):
    rows = b.classified(spark, sf).where("outcome = 'MIGRATE'")
    payload = _map_text(decide.create_payload(b.RUN_ID)).alias("payload")
    return rows.select("part", "source_line", payload)


@query(
    "join_rule_ids",
    f"{o.WITH_OVERLAP} SELECT part, source_line, CASE WHEN verdict IS DISTINCT FROM 'PREVALIDATION' THEN rule_ids END AS rule_ids FROM classified",
)
def join_rule_ids(spark, sf):
    rows = b.classified(spark, sf, rules.overlap_rules(spark))
    return rows.select("part", "source_line", values.join_rule_ids(F.col("rule_ids")).alias("rule_ids"))


PERMISSION_SQL = "'12.' || (c_nationkey % 5) || '.' || lower(c_mktsegment) || '.' || (c_custkey % 4)"


def _permission():
    return F.concat_ws(
        ".",
        F.lit("12"),
        (F.col("c_nationkey") % 5).cast("string"),
        F.lower("c_mktsegment"),
        (F.col("c_custkey") % 4).cast("string"),
    )


@query(
    "split_permission",
    f"SELECT c_custkey, split_part(p, '.', 1) AS application, split_part(p, '.', 2) AS service, "
    f"split_part(p, '.', 3) AS role, split_part(p, '.', 4) AS level FROM (SELECT c_custkey, {PERMISSION_SQL} AS p FROM customer)",
)
def split_permission(spark, sf):
    rows = b.table(spark, sf, "customer").select("c_custkey", _permission().alias("permission"))
    return rows.select("c_custkey", *values.split_permission(F.col("permission")))


# ---- row rules -------------------------------------------------------------


@query("prevalidate", f"{o.WITH_INPUTS} SELECT part, source_line, detail FROM valid WHERE detail IS NOT NULL")
def prevalidate(spark, sf):
    checked = validate.prevalidate(b.cases(spark, sf))
    return checked.where("detail is not null").select("part", "source_line", "detail")


def _rule_query(rule: str):
    def run(spark, sf):
        return validate.check_rule(b.cases(spark, sf), rule).select("part", "source_line", "detail")

    return run


for _rule, _sql in o.RULE_SQL.items():
    query(
        _rule,
        f"{o.WITH_CASES} SELECT * FROM (SELECT part, source_line, {_sql} AS detail FROM rec) WHERE detail IS NOT NULL",
    )(_rule_query(_rule))


@query(
    "rule_duplicate_key",
    f"{o.WITH_CASES} SELECT part, source_line, case_ref FROM rec WHERE case_ref IN "
    "(SELECT case_ref FROM rec WHERE case_ref <> '' GROUP BY case_ref HAVING count(*) > 1)",
)
def rule_duplicate_key(spark, sf):
    found = validate.records_with_duplicate_key(b.cases(spark, sf))
    return found.select("part", "source_line", "case_ref")


@query(
    "rule_truncated_group",
    f"{o.WITH_CASES}, totals AS (SELECT l_orderkey, count(*) + CAST(l_orderkey % 37 = 0 AS INT) AS declared FROM lineitem GROUP BY 1) "
    "SELECT part, source_line, declared, n AS n_arrived FROM (SELECT part, source_line, declared, "
    + " + ".join(f"CAST((vt_{n}_date <> '' OR vt_{n}_result <> '') AS INT)" for n in o.SLOTS)
    + " AS n FROM rec JOIN totals ON k = l_orderkey) WHERE declared > n",
)
def rule_truncated_group(spark, sf):
    """The independent count is the number of attempts the source table holds, and
    one more for the cases planted to have lost one."""
    lost = b.every(F.col("l_orderkey"), 37).cast("int")
    totals = b.long_attempts(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select("l_orderkey", (F.col("n") + lost).alias("total"))
    counted = b.cases(spark, sf).withColumn("k", b.order_key())
    joined = counted.join(totals, F.col("k") == F.col("l_orderkey"), "left")
    return validate.truncated_groups(joined, F.col("total")).select(
        "part", "source_line", "declared", F.size("attempts").alias("n_arrived")
    )
