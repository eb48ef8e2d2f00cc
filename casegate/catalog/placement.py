"""Queries over the decision table, its reports and comparisons."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from casegate.catalog import bindings as b
from casegate.catalog import intake
from casegate.catalog import oracle as o
from casegate.catalog.reconciliation import GATE_SQL
from casegate.catalog.registry import query
from casegate.functions import values
from casegate.functions.text import is_present
from casegate.operators import decide, integrity, load, normalise, reconcile, report, validate
from casegate.operators.ledger import BUCKETS, ROW_KEY
from casegate.plans.classify import classify, rule_change_diff
from casegate.session import materialised
from casegate.sources import export, manifest, rules, tables
from casegate.sources.ledger_store import LedgerStore

KEY = ["part", "source_line"]
PLACED = [*KEY, "outcome", "target_element", "reason_code", "redundant"]


@query(
    "decision_table_join",
    f"{o.WITH_OVERLAP} SELECT part, source_line, rule_id, h_outcome AS outcome, h_target AS target_element, "
    "h_reason AS reason_code FROM keyed LEFT JOIN hits USING (k) WHERE ok",
)
def decision_table_join(spark, sf):
    """All hits of every readable case, over the overlapping rules."""
    rows = intake.inputs(spark, sf).where("detail is null").select(*KEY, "cell")
    hits = decide.decision_table_join(rows, rules.overlap_rules(spark))
    return hits.select(*KEY, "rule_id", "outcome", "target_element", "reason_code")


@query(
    "resolve_hits",
    f"{o.WITH_OVERLAP} SELECT part, source_line, coalesce(n_hits, 0) AS n_hits, coalesce(n_decisions, 0) AS n_decisions, "
    "CASE WHEN n_hits IS NULL THEN 'UNMATCHED' WHEN n_decisions > 1 THEN 'AMBIGUOUS' WHEN n_hits > 1 THEN 'REDUNDANT' ELSE 'SINGLE' END AS resolution "
    "FROM keyed LEFT JOIN decided USING (k) WHERE ok",
)
def resolve_hits(spark, sf):
    rows = intake.inputs(spark, sf).where("detail is null").select(*KEY, "cell")
    resolved = decide.resolve_hits(decide.rule_cells(rules.overlap_rules(spark)))
    n_hits, n_decisions = F.coalesce("n_hits", F.lit(0)), F.coalesce("n_decisions", F.lit(0))
    resolution = (
        F.when(n_hits == 0, "UNMATCHED")
        .when(n_decisions > 1, "AMBIGUOUS")
        .when(n_hits > 1, "REDUNDANT")
        .otherwise("SINGLE")
    )
    # One row per cell: at most 96.
    return rows.join(F.broadcast(resolved), "cell", "left").select(
        *KEY,
        n_hits.cast("bigint").alias("n_hits"),
        n_decisions.cast("bigint").alias("n_decisions"),
        resolution.alias("resolution"),
    )


@query("classify_baseline", f"{o.WITH_CLASSIFIED} SELECT {', '.join(PLACED)}, detail FROM classified")
def classify_baseline(spark, sf):
    return b.classified(spark, sf).select(*PLACED, "detail")


@query("classify_overlap", f"{o.WITH_OVERLAP} SELECT {', '.join(PLACED)}, detail FROM classified")
def classify_overlap(spark, sf):
    """With rules that repeat and contradict each other: redundant, ambiguous and
    disallowed targets appear."""
    return b.classified(spark, sf, rules.overlap_rules(spark)).select(*PLACED, "detail")


@query("classify_text_export", f"{o.WITH_CLASSIFIED} SELECT {', '.join(PLACED)}, source_hash FROM classified")
def classify_text_export(spark, sf):
    """From the text files: read, number, hash, split, nest, check and place."""
    records = export.scan_export(spark, b.export_path(spark, sf))
    return classify(records, b.boundary()).select(*PLACED, "source_hash")


@query(
    "target_allowlist",
    f"{o.WITH_OVERLAP} SELECT part, source_line, h_target AS chosen, target_element, reason_code FROM classified "
    "WHERE verdict = 'CITIZEN_TARGET'",
)
def target_allowlist(spark, sf):
    """Cases whose rules, one or several that agree, choose a target outside the list."""
    rows = b.classified(spark, sf, rules.overlap_rules(spark)).where("reason_code = 'CITIZEN_TARGET'")
    table = rules.overlap_rules(spark).select("rule_id", F.col("target_element").alias("chosen"))
    first = rows.withColumn("rule_id", F.get("rule_ids", F.lit(0)))  # rules that agree have one target
    return first.join(F.broadcast(table), "rule_id").select(*KEY, "chosen", "target_element", "reason_code")


@query(
    "contract_check",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, rule_ids, outcome, target_element, reason_code, redundant "
    "FROM classified WHERE verdict = 'CONTRACT_UNSATISFIED'",
)
def contract_check(spark, sf):
    rows = b.classified(spark, sf).where("reason_code = 'CONTRACT_UNSATISFIED'")
    return rows.select(
        *KEY,
        values.join_rule_ids(F.col("rule_ids")).alias("rule_ids"),
        "outcome",
        "target_element",
        "reason_code",
        "redundant",
    )


_contract_values = o.values(
    [(t, ",".join(names)) for t, names in decide.TARGET_CONTRACT.items()], ["target_element", "required"]
)


@query(
    "contract_lookup",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, c.target_element, coalesce(required, '') AS required "
    f"FROM classified c LEFT JOIN (SELECT * FROM {_contract_values}) USING (target_element)",
)
def contract_lookup(spark, sf):
    rows = b.classified(spark, sf).select(*KEY, "target_element")
    found = decide.contract_lookup(rows, decide.contract_table(spark))
    return found.select(*KEY, "target_element", F.array_join("required", ",").alias("required"))


@query(
    "null_outcome_guard",
    f"{o.WITH_OVERLAP}, fired AS (SELECT rule_id, count(*) AS n_records FROM hits GROUP BY rule_id) "
    "SELECT rule_id, outcome IN ('MIGRATE', 'SKIP', 'QUARANTINE') AS known_outcome, coalesce(n_records, 0) AS n_records "
    "FROM rules LEFT JOIN fired USING (rule_id)",
)
def null_outcome_guard(spark, sf):
    """Every rule, whether its outcome is usable, and the cases it would decide."""
    table = rules.overlap_rules(spark)
    broken = decide.null_outcome_rules(table).select("rule_id", F.lit(True).alias("broken"))
    used = decide.rule_usage(table, intake.inputs(spark, sf)).join(broken, "rule_id", "left")
    return used.select("rule_id", F.col("broken").isNull().alias("known_outcome"), "n_records")


_coverage = (
    "CASE WHEN coalesce(nh, 0) = 0 THEN 'UNCOVERED' WHEN nd > 1 THEN 'AMBIGUOUS' WHEN nh > 1 THEN 'REDUNDANT' ELSE 'COVERED' END"
)
COVERAGE_SQL = (
    ", per_cell AS (SELECT cell, count(*) AS nh, count(DISTINCT coalesce(outcome, '-') || '|' || coalesce(target_element, '-') || '|' || coalesce(reason_code, '-')) AS nd, "
    "string_agg(rule_id, ',' ORDER BY position) AS rule_ids FROM cell_hits GROUP BY cell), "
    "seen AS (SELECT cell, count(*) AS n_records FROM keyed WHERE ok GROUP BY cell), "
    f"coverage AS (SELECT cells.cell, i_c, i_i, i_e, i_w, i_f, i_v, coalesce(nh, 0) AS n_hits, rule_ids, {_coverage} AS coverage, "
    "NOT ((i_e OR i_c) AND NOT i_i) AS reachable, coalesce(n_records, 0) AS n_records "
    "FROM cells LEFT JOIN per_cell USING (cell) LEFT JOIN seen USING (cell))"
)


@query(
    "domain_coverage",
    f"{o.WITH_OVERLAP},{intake.OBSERVED_RULES_SQL}{COVERAGE_SQL} SELECT cell, i_c AS has_date_completed, i_i AS has_issued, "
    "i_e AS has_expired, i_w AS within_cutoff, i_f AS fee_paid, i_v AS vision_outcome, n_hits, rule_ids, coverage, reachable, n_records FROM coverage",
)
def domain_coverage(spark, sf):
    """The whole domain against the rules, with the cases seen in each cell."""
    return decide.domain_coverage(spark, rules.overlap_rules(spark), intake.inputs(spark, sf))


@query(
    "reachable_coverage",
    f"{o.WITH_CLASSIFIED},{intake.OBSERVED_RULES_SQL}{COVERAGE_SQL} "
    "SELECT coverage, count(*) AS n_cells, CAST(sum(n_records) AS BIGINT) AS n_records FROM coverage WHERE reachable GROUP BY coverage",
)
def reachable_coverage(spark, sf):
    """Coverage of the cells that remain once contradictions are stopped."""
    covered = decide.domain_coverage(spark, rules.baseline_rules(spark), intake.inputs(spark, sf))
    return covered.where("reachable").groupBy("coverage").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_records").alias("n_records")
    )


# ---- collapse --------------------------------------------------------------


@query(
    "collapse_latest",
    f"{o.WITH_CASES} SELECT part, source_line, {o.COLLAPSE_SQL['latest']} AS vision_outcome FROM rec",
)
def collapse_latest(spark, sf):
    from casegate.operators.validate import typed

    outcome = normalise.collapse_latest(F.col("_attempts"))
    return typed(b.cases(spark, sf)).select(*KEY, outcome.alias("vision_outcome"))


@query(
    "collapse_policies",
    f"{o.WITH_CASES} SELECT part, source_line, "
    + ", ".join(f"{sql} AS {name}" for name, sql in o.COLLAPSE_SQL.items())
    + ", "
    + " + ".join(f"CAST((vt_{n}_date <> '' OR vt_{n}_result <> '') AS INT)" for n in o.SLOTS)
    + " AS n_attempts FROM rec",
)
def collapse_policies(spark, sf):
    """The contested alternatives side by side."""
    from casegate.operators.validate import typed

    columns = [f(F.col("_attempts")).alias(name) for name, f in normalise.COLLAPSE_POLICIES.items()]
    return typed(b.cases(spark, sf)).select(*KEY, *columns, F.size("attempts").alias("n_attempts"))


_attempt_columns = ["l_orderkey", *b.ATTEMPT_ORDER, "result"]


@query(
    "collapse_latest_window",
    f"{o.WITH_CASES} SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linenumber, result FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in b.ATTEMPT_ORDER)}) AS back FROM long_attempts) WHERE back = 1",
)
def collapse_latest_window(spark, sf):
    """The long form: the last attempt of every order."""
    last = normalise.latest_attempt(b.long_attempts(spark, sf), ["l_orderkey"], b.ATTEMPT_ORDER)
    return last.select("l_orderkey", b.day(F.col("l_shipdate")).alias("day"), "l_linenumber", "result")


# ---- reports ---------------------------------------------------------------


@query(
    "count_by_outcome",
    f"{o.WITH_CLASSIFIED} SELECT v.outcome, count(c.outcome) AS n FROM {o.values([(x,) for x in decide.OUTCOMES], ['outcome'])} "
    "LEFT JOIN classified c USING (outcome) GROUP BY 1",
)
def count_by_outcome(spark, sf):
    return report.count_by_outcome(spark, report.patterns(b.classified(spark, sf)))


@query(
    "count_by_target",
    f"{o.WITH_CLASSIFIED} SELECT target_element, count(*) AS n FROM classified WHERE target_element IS NOT NULL GROUP BY 1",
)
def count_by_target(spark, sf):
    return report.count_by_target(report.patterns(b.classified(spark, sf)))


@query(
    "count_by_reason",
    f"{o.WITH_CLASSIFIED} SELECT reason_code, count(*) AS n FROM classified WHERE reason_code IS NOT NULL GROUP BY 1",
)
def count_by_reason(spark, sf):
    return report.count_by_reason(report.patterns(b.classified(spark, sf)))


_unmatched_sql = (
    f"{o.WITH_CLASSIFIED} SELECT combination, count(*) AS n FROM classified WHERE reason_code = 'UNMATCHED' GROUP BY 1"
)


@query("unmatched_combinations", _unmatched_sql)
def unmatched_combinations(spark, sf):
    return report.unmatched_combinations(report.patterns(b.classified(spark, sf)))


@query(
    "top_unmatched",
    f"SELECT *, CAST(row_number() OVER (ORDER BY n DESC, combination) AS INT) AS place FROM ({_unmatched_sql})",
)
def top_unmatched(spark, sf):
    """All gaps of the rule table, the most frequent first. The table has 96 cells at most."""
    gaps = report.unmatched_combinations(report.patterns(b.classified(spark, sf)))
    return gaps.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "combination")))


@query(
    "redundant_rule_count",
    f"{o.WITH_OVERLAP} SELECT count(*) FILTER (WHERE redundant) AS n_redundant FROM classified",
)
def redundant_rule_count(spark, sf):
    return report.redundant_rule_count(report.patterns(b.classified(spark, sf, rules.overlap_rules(spark))))


def _report_sql(prefix: str) -> str:
    sections = {
        "outcome": "outcome",
        "target": "target_element",
        "reason": "reason_code",
        "unmatched": "CASE WHEN reason_code = 'UNMATCHED' THEN combination END",
        "redundant": "CASE WHEN redundant THEN 'rules' END",
        "total": "'records'",
    }
    body = " UNION ALL ".join(f"SELECT '{s}' AS section, {e} AS key FROM classified" for s, e in sections.items())
    return (
        f"{prefix}, keys AS ({body}) SELECT section, key, count(*) AS n FROM keys WHERE key IS NOT NULL GROUP BY ALL"
    )


@query("classification_report", _report_sql(o.WITH_CLASSIFIED))
def classification_report(spark, sf):
    return report.classification_report(spark, b.classified(spark, sf))


@query("classification_report_overlap", _report_sql(o.WITH_OVERLAP))
def classification_report_overlap(spark, sf):
    return report.classification_report(spark, b.classified(spark, sf, rules.overlap_rules(spark)))


_gate_buckets = " UNION ALL ".join(
    f"SELECT 'gate', '{name}', (SELECT count(*) FROM ledger WHERE {o.BUCKET_OF} = '{name}')" for name in BUCKETS
)
_blocks_sql = f"""{o.WITH_LEDGER},{GATE_SQL}
SELECT 'load' AS section, key, (SELECT count(*) FROM ledger WHERE action = wanted) AS n FROM (VALUES ('skipped', 'RECORD_SKIP'),
  ('quarantined', 'RECORD_QUARANTINE'), ('already_loaded', 'ALREADY_LOADED'), ('refused_pending', 'REFUSE_PENDING'), ('commands', 'CREATE')) t(key, wanted)
UNION ALL SELECT 'answers', key, (SELECT count(*) FROM ledger WHERE code = wanted) FROM (VALUES ('created', 200), ('already_existed', 409), ('rejected', 500)) t(key, wanted)
UNION ALL {_gate_buckets}
UNION ALL SELECT 'gate', 'TOTAL', (SELECT count(*) FROM ledger)
UNION ALL SELECT 'gate', 'MANIFEST', (SELECT count(*) FROM orders)
UNION ALL SELECT 'gate', 'PASSED', (SELECT CAST(bool_and(n = 0) AS INT) FROM checks)
UNION ALL SELECT 'gate failure', "check", n FROM checks WHERE n <> 0
UNION ALL SELECT 'release', 'released', (SELECT count(*) FROM ledger WHERE state = 'CREATED' AND coalesce(instance_key % 37, 1) <> 0)
UNION ALL SELECT 'release', 'failed', (SELECT count(*) FROM ledger WHERE state = 'CREATED' AND instance_key % 37 = 0)"""


@query(
    "write_reports",
    f"SELECT * FROM ({_report_sql(o.WITH_CLASSIFIED)}) UNION ALL SELECT * FROM ({_blocks_sql})",
)
def write_reports(spark, sf):
    """The blocks of classification, load, gate and release written as CSV and read
    back. Load and release are counted by the writes of their events."""

    def write(path: str) -> None:
        store = LedgerStore(spark, f"{path}-ledger")
        store.append(b.prior_events(spark, sf))
        plan = spark.read.parquet(b.plan_path(spark, sf))
        planned = report.observed(plan, "load", report.LOAD_COUNTS, lambda rows: rows.write.parquet(f"{path}-plan"))
        store.append(load.intent_events(plan, b.RUN_ID, b.LOAD_SEQ))
        commands = load.create_commands(plan, b.RUN_ID)
        answers = load.response_events(load.apply_create_responses(commands, b.create_answers(commands)), b.RUN_ID, b.LOAD_SEQ + 2)
        answered = report.observed(answers, "answers", report.ANSWER_COUNTS, store.append)
        ledger = store.settled(b.RUN_ID)
        active = tables.read_engine_snapshot(spark, b.snapshot_path(spark, sf), b.PROCESS_ID)
        gate = reconcile.gate_block(reconcile.gate_counts(ledger, active), b.table(spark, sf, "orders").count())
        held = ledger.where("state = 'CREATED'").select(
            *ROW_KEY, F.lit("TRANSITION").alias("kind"), F.lit(b.LOAD_SEQ + 3).alias("seq"),
            F.when(F.col("instance_key") % 37 == 0, "RELEASE_FAILED").otherwise("RELEASED").alias("state"),
        )
        released = report.observed(tables.ledger_events(held), "release", report.RELEASE_COUNTS, store.append)
        blocks = report.classification_report(spark, b.classified(spark, sf))
        for one in (planned, answered, gate, released):
            blocks = blocks.unionByName(one)
        blocks.write.option("header", True).csv(path)

    path = b.written(spark, sf, "report-csv", write)
    return spark.read.schema("section string, key string, n bigint").option("header", True).csv(path)


@query("persist_run_counts", f"SELECT '{b.RUN_ID}' AS run_id, * FROM ({_report_sql(o.WITH_CLASSIFIED)})")
def persist_run_counts(spark, sf):
    """Counts of a dry run kept under its run id."""

    def write(path: str) -> None:
        tables.append_report(report.classification_report(spark, b.classified(spark, sf)), path, b.RUN_ID)

    return spark.read.parquet(b.written(spark, sf, "run-counts", write)).select("run_id", "section", "key", "n")


_profile = {
    "completed": "CAST(date_completed <> '' AS VARCHAR)",
    "issued": "CAST(issued <> '' AS VARCHAR)",
    "expired": "CAST(expired <> '' AS VARCHAR)",
    "fee": f"CASE WHEN ({o.flag('fee_paid')}) IS NULL THEN 'OTHER' WHEN {o.flag('fee_paid')} THEN 'TRUE' ELSE 'FALSE' END",
    "attempts": "CASE WHEN n_att >= 3 THEN '3+' ELSE CAST(n_att AS VARCHAR) END",
    "any_pass": "CAST((" + " OR ".join(f"upper(vt_{n}_result) = 'PASS'" for n in o.SLOTS) + ") AS VARCHAR)",
    "latest": o.COLLAPSE_SQL["latest"],
    "has_user": "CAST(applicant_user_id <> '' AS VARCHAR)",
}


@query(
    "field_profile",
    f"{o.WITH_CASES}, flagged AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _profile.items())
    + " FROM (SELECT *, "
    + " + ".join(f"CAST((vt_{n}_date <> '' OR vt_{n}_result <> '') AS INT)" for n in o.SLOTS)
    + " AS n_att FROM rec)) SELECT "
    + ", ".join(f"coalesce({n}, '*') AS {n}" for n in _profile)
    + f", count(*) AS n FROM flagged GROUP BY CUBE ({', '.join(_profile)})",
)
def field_profile(spark, sf):
    return report.field_profile(b.cases(spark, sf), list(_profile))


@query(
    "key_and_age_profile",
    f"{o.WITH_CASES}, aged AS (SELECT nullif(case_ref, '') AS key, date_diff('day', {o.day('last_updated')}, DATE '{b.FREEZE_DATE}') AS age FROM rec) "
    "SELECT count(*) AS n_records, count(key) AS n_keyed, count(age) AS n_aged, min(age) AS min_age, max(age) AS max_age, "
    "true AS keys_close, true AS median_close, true AS p90_close FROM aged",
)
def key_and_age_profile(spark, sf):
    """Sketches per part, stored, read back and merged: exact columns, and whether each
    estimate lies within its stated error of the exact value."""
    as_of = F.lit(b.FREEZE_DATE).cast("date")

    def write(path: str) -> None:
        report.part_sketches(b.cases(spark, sf), as_of).write.parquet(path)

    found = report.key_and_age_profile(spark.read.parquet(b.written(spark, sf, "sketches", write)))
    est = found.first()  # one row
    key = F.when(is_present(F.col("case_ref")), F.col("case_ref"))
    ages = validate.typed(b.cases(spark, sf)).select(key.alias("key"), F.date_diff(as_of, F.col("_updated_day")).alias("age"))

    def close(value: int, q: float):
        """Whether the value's rank is that of the quantile."""
        below, upto = (F.count_if(c) / F.count("age") for c in (F.col("age") < value, F.col("age") <= value))
        return F.lit(q).between(below - 0.02, upto + 0.02)

    flags = ages.agg(
        (F.abs(F.countDistinct("key") - est["n_keys"]) <= 0.03 * F.countDistinct("key")).alias("keys_close"),
        close(est["median_age"], 0.5).alias("median_close"),
        close(est["p90_age"], 0.9).alias("p90_close"),
    ).first()
    return found.select(
        "n_records", "n_keyed", "n_aged", "min_age", "max_age",
        *[F.lit(flags[c]).alias(c) for c in ("keys_close", "median_close", "p90_close")],
    )


@query(
    "placement_rate",
    f"{o.WITH_CLASSIFIED} SELECT permit_category, count(*) AS n, count(*) FILTER (WHERE outcome = 'MIGRATE') AS n_placed, "
    "round(count(*) FILTER (WHERE outcome = 'MIGRATE') / count(*), 6) AS rate FROM classified GROUP BY 1",
)
def placement_rate(spark, sf):
    return report.placement_rate(b.classified(spark, sf), "permit_category")


# ---- integrity and comparisons ---------------------------------------------


@query(
    "header_verify",
    f"SELECT part, {intake.HEADER_HASH_SQL} AS header_hash, 'sha256:' || sha256('CASE_REF,ISN') AS expected_hash FROM ({intake.PARTS_SQL})",
)
def header_verify(spark, sf):
    """Against the hash of another header: every part is reported."""
    numbered = export.number_lines(export.read_lines(spark, b.export_path(spark, sf)))
    other = F.concat(F.lit("sha256:"), F.sha2(F.lit("CASE_REF,ISN"), 256))
    return integrity.header_verify(export.header_hashes(numbered), other)


@query(
    "manifest_verify",
    f"{intake.WITH_MANIFEST} SELECT * FROM (SELECT part, source_line, CASE WHEN m.source_hash IS NULL THEN 'NOT_IN_MANIFEST' "
    "WHEN r.source_hash IS NULL THEN 'NOT_IN_SOURCE' WHEN m.source_hash <> r.source_hash THEN 'HASH_CHANGED' END AS problem, "
    "m.source_hash AS expected_hash, r.source_hash AS actual_hash FROM rec r FULL JOIN manifest m USING (part, source_line)) WHERE problem IS NOT NULL",
)
def manifest_verify(spark, sf):
    records = export.scan_export(spark, b.export_path(spark, sf))
    return integrity.manifest_verify(records, intake.manifest_rows(spark, sf))


@query(
    "manifest_missing_in_source",
    f"{intake.WITH_MANIFEST} SELECT part, source_line, case_ref, source_hash FROM manifest m WHERE NOT EXISTS "
    "(SELECT 1 FROM rec r WHERE r.part = m.part AND r.source_line = m.source_line)",
)
def manifest_missing_in_source(spark, sf):
    missing = integrity.manifest_missing_in_source(b.cases(spark, sf), intake.manifest_rows(spark, sf))
    return missing.select(*KEY, "case_ref", "source_hash")


@query(
    "expectation_diff",
    f"""{intake.WITH_EXPECTED}, pairs AS (
      SELECT part, source_line, e.part IS NOT NULL AS has_e, c.part IS NOT NULL AS has_c, c.case_ref AS c_ref, e.case_ref AS e_ref,
        e.outcome AS e_o, e.target_element AS e_t, e.reason_code AS e_r, c.outcome AS c_o, c.target_element AS c_t, c.reason_code AS c_r
      FROM classified c FULL JOIN expected e USING (part, source_line))
    SELECT part, source_line, c_ref AS case_ref, 'expectation' AS field, 'a row' AS expected, 'none' AS actual FROM pairs WHERE NOT has_e
    UNION ALL SELECT part, source_line, e_ref, 'record', 'a record', 'none' FROM pairs WHERE NOT has_c
    UNION ALL SELECT part, source_line, e_ref, 'outcome', e_o, c_o FROM pairs WHERE has_e AND has_c AND e_o IS DISTINCT FROM c_o
    UNION ALL SELECT part, source_line, e_ref, 'target_element', e_t, c_t FROM pairs WHERE has_e AND has_c AND e_t IS DISTINCT FROM c_t
    UNION ALL SELECT part, source_line, e_ref, 'reason_code', e_r, c_r FROM pairs WHERE has_e AND has_c AND e_r IS DISTINCT FROM c_r""",
)
def expectation_diff(spark, sf):
    return integrity.expectation_diff(b.classified(spark, sf), intake.expected(spark, sf))


@query(
    "halt_on_expectation",
    f"""{intake.WITH_EXPECTED}, pairs AS (
      SELECT e.part IS NOT NULL AS has_e, c.part IS NOT NULL AS has_c,
        (e.outcome IS DISTINCT FROM c.outcome OR e.target_element IS DISTINCT FROM c.target_element OR e.reason_code IS DISTINCT FROM c.reason_code) AS differs
      FROM classified c FULL JOIN expected e USING (part, source_line))
    SELECT count(*) FILTER (WHERE has_e AND has_c) AS checked, count(*) FILTER (WHERE has_e AND has_c AND differs) AS differing,
      count(*) FILTER (WHERE NOT has_e) AS without_expectation, count(*) FILTER (WHERE NOT has_c) AS without_record,
      count(*) FILTER (WHERE NOT has_e OR NOT has_c OR differs) = 0 AS passed FROM pairs""",
)
def halt_on_expectation(spark, sf):
    """The one row the halt decision is taken from."""
    return integrity.expectation_summary(b.classified(spark, sf), intake.expected(spark, sf))


@query(
    "partition_complete",
    f"{o.WITH_CLASSIFIED} SELECT count(*) FILTER (WHERE outcome NOT IN ('MIGRATE', 'SKIP', 'QUARANTINE')) AS n_lost, "
    "count(*) - count(DISTINCT k) AS n_repeated FROM classified",
)
def partition_complete(spark, sf):
    return integrity.partition_complete(b.classified(spark, sf), b.cases(spark, sf))


@query(
    "rule_change_diff",
    f"{o.WITH_CLASSIFIED},{o.placed(rules.OVERLAP_RULES, '_2')} SELECT a.part, a.source_line, a.case_ref, "
    "a.outcome AS before_outcome, a.target_element AS before_target_element, a.reason_code AS before_reason_code, "
    "z.outcome AS after_outcome, z.target_element AS after_target_element, z.reason_code AS after_reason_code "
    "FROM classified a JOIN classified_2 z USING (k) WHERE a.outcome IS DISTINCT FROM z.outcome "
    "OR a.target_element IS DISTINCT FROM z.target_element OR a.reason_code IS DISTINCT FROM z.reason_code",
)
def rule_change_query(spark, sf):
    return rule_change_diff(
        b.cases(spark, sf), b.boundary(), rules.baseline_rules(spark), rules.overlap_rules(spark)
    )


@query(
    "canonical_equal",
    f"{o.WITH_CLASSIFIED},{o.placed(rules.OVERLAP_RULES, '_2')}, "
    + ", ".join(
        f"form{s} AS (SELECT case_ref, outcome, target_element, reason_code, CASE WHEN verdict IS DISTINCT FROM 'PREVALIDATION' "
        f"THEN coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM unnest(string_split(rule_ids, ',')) t(r)), '') ELSE '' END AS rules FROM classified{s})"
        for s in ("", "_2")
    )
    + " SELECT case_ref, outcome, target_element, reason_code, rules, count(*) FILTER (WHERE side = 1) AS n_left, "
    "count(*) FILTER (WHERE side = 2) AS n_right FROM (SELECT *, 1 AS side FROM form UNION ALL SELECT *, 2 FROM form_2) "
    "GROUP BY ALL HAVING count(*) FILTER (WHERE side = 1) <> count(*) FILTER (WHERE side = 2)",
)
def canonical_equal(spark, sf):
    """Two sources as sets: text export under the baseline, landed lines under the
    overlapping rules; what does not cancel is the difference."""
    left = classify(export.scan_export(spark, b.export_path(spark, sf)), b.boundary())
    right = b.classified(spark, sf, rules.overlap_rules(spark))
    return integrity.multiset_diff(integrity.canonical_form(left), integrity.canonical_form(right))


@query(
    "manifest_build",
    f"{o.WITH_CASES} SELECT part, source_line || ',' || case_ref || ',' || source_hash AS raw FROM rec "
    f"UNION ALL SELECT part, unnest(['freezeDate={b.FREEZE_DATE}', 'cutoffMonths={b.CUTOFF_MONTHS}', 'runId={b.RUN_ID}', "
    f"'recordCount=' || count(*), 'headerHash=' || {intake.HEADER_HASH_SQL}, 'SOURCE_LINE,CASE_REF,SOURCE_HASH']) FROM rec GROUP BY part",
)
def manifest_build(spark, sf):
    numbered = export.number_lines(export.read_lines(spark, b.export_path(spark, sf)))
    records = export.source_records(numbered, b.header(spark, sf))
    lines = manifest.build_manifest_lines(
        records, export.header_hashes(numbered), b.RUN_ID, b.FREEZE_DATE, b.CUTOFF_MONTHS
    )
    return lines.select("part", "raw")


@query(
    "manifest_diff",
    f"""{o.WITH_CASES}, sides AS (
      SELECT case_ref, source_hash, 1 AS side FROM rec
      UNION ALL SELECT CASE WHEN k % 47 = 0 THEN case_ref || '-N' ELSE case_ref END,
        CASE WHEN k % 53 = 0 THEN 'sha256:changed' ELSE source_hash END, 2 FROM rec WHERE k % 59 <> 0),
    counted AS (SELECT case_ref, source_hash, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS z FROM sides GROUP BY ALL),
    per_key AS (SELECT case_ref, CAST(sum(greatest(a - z, 0)) AS BIGINT) AS gone, CAST(sum(greatest(z - a, 0)) AS BIGINT) AS come FROM counted WHERE a <> z GROUP BY 1)
    SELECT case_ref, least(gone, come) AS n_changed, come - least(gone, come) AS n_added, gone - least(gone, come) AS n_removed FROM per_key""",
)
def manifest_diff(spark, sf):
    """The export against a later one with renamed, changed and removed cases."""
    k = b.order_key()
    old = b.cases(spark, sf)
    new = old.where(~b.every(k, 59)).select(
        F.when(b.every(k, 47), F.concat("case_ref", F.lit("-N"))).otherwise(F.col("case_ref")).alias("case_ref"),
        F.when(b.every(k, 53), "sha256:changed").otherwise(F.col("source_hash")).alias("source_hash"),
    )
    return integrity.export_changes(old, new)


@query(
    "backcheck_sample",
    f"{o.WITH_CLASSIFIED} SELECT * FROM (SELECT outcome, part, source_line, case_ref, target_element, reason_code, "
    "row_number() OVER (PARTITION BY outcome ORDER BY sha256(part || '|' || source_line || '|2026')) AS rank FROM classified) WHERE rank <= 20",
)
def backcheck_sample(spark, sf):
    return reconcile.backcheck_sample(b.classified(spark, sf), 20, "2026")


@query("order_by_line", f"{o.WITH_CLASSIFIED} SELECT part, source_line, case_ref, outcome FROM classified ORDER BY 1, 2")
def order_by_line(spark, sf):
    """Written before it is sorted: the sort reads its rows twice, first to find ranges."""
    return materialised(b.classified(spark, sf).select(*KEY, "case_ref", "outcome")).orderBy(*KEY)


@query(
    "rule_targets_in_model",
    f"{o.WITH_OVERLAP} SELECT r.target_element, r.target_element IN ('vision-assessment', 'cashier-fee-review') AS in_model, "
    "count(DISTINCT h.k) AS n_records FROM (SELECT DISTINCT target_element FROM rules WHERE target_element IS NOT NULL) r "
    "LEFT JOIN hits h ON h.h_target = r.target_element GROUP BY ALL",
)
def rule_targets_in_model(spark, sf):
    """Every target of the rules against a model in XML that lacks some of them, with the
    cases that any rule sends there."""
    targets = [t for t in decide.BACK_OFFICE_TARGETS if t != "issuing-review"]
    xml = "<process>" + "".join(f'<userTask id="{t}"/>' for t in targets) + "</process>"

    def write(path: str) -> None:
        spark.range(0, 1, 1, 1).select(F.lit(xml).alias("value")).write.text(path)

    path = b.written(spark, sf, "model-xml", write)
    elements = rules.scan_model_elements(spark, path)
    table = rules.overlap_rules(spark)
    seen = intake.inputs(spark, sf).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return reconcile.rule_targets(table, decide.rule_cells(table), elements, seen)
