"""The binding and the placement written again as plain SQL, independent of the
DataFrame code, as chains of common table expressions to build oracles from."""

from __future__ import annotations

from casegate.catalog.bindings import (
    ATTEMPT_ORDER,
    CUTOFF_MONTHS,
    FREEZE_DATE,
    HEADER_END,
    HEADER_START,
    NEW_KEY,
    ORPHAN_KEY,
    PART_ROWS,
    PRIOR_KEY,
    RUN_ID,
)
from casegate.operators.decide import TARGET_CONTRACT
from casegate.operators.ledger import ALLOWED_EDGES, STATE_BUCKETS
from casegate.sources.rules import BASELINE_RULES, OVERLAP_RULES

# Attempts the SQL can hold; the columns that are written follow the data.
SLOTS = range(1, 25)
_before = [name.lower() for name in HEADER_START.split(",")]
_after = [name.lower() for name in HEADER_END.split(",")]
_width = "(SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))"
HEADER_SQL = (
    f"'{HEADER_START},' || array_to_string(['VT_' || i || '_DATE,VT_' || i || '_RESULT' "
    f"FOR i IN range(1, {_width} + 1)], ',') || ',{HEADER_END}'"
)
BOUNDARY = f"CAST(DATE '{FREEZE_DATE}' - INTERVAL {CUTOFF_MONTHS} MONTH AS DATE)"


def day(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({x} AS DATE) END"


def flag(x: str) -> str:
    return (
        f"CASE WHEN upper({x}) IN ('TRUE','T','Y','YES','1') THEN true "
        f"WHEN upper({x}) IN ('FALSE','F','N','NO','0','') THEN false END"
    )


def values(rows: list[tuple], names: list[str]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else f"'{v}'"

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


RULE_NAMES = [
    "rule_id", "has_date_completed", "has_issued", "has_expired", "within_cutoff", "fee_paid",
    "vision_outcome", "outcome", "target_element", "reason_code", "position",
]


def rules_values(rules: list[tuple]) -> str:
    source = values([(*r, i) for i, r in enumerate(rules)], RULE_NAMES)
    typed = ", ".join(
        f"CAST({n} AS BOOLEAN) AS {n}" if n in RULE_NAMES[1:6] else f"CAST({n} AS VARCHAR) AS {n}"
        for n in RULE_NAMES[:-1]
    )
    return f"SELECT {typed}, position FROM {source}"


_attempt_order = ", ".join(ATTEMPT_ORDER)
_slots = ", ".join(
    f"max(CASE WHEN n={n} THEN d END) AS d{n}, max(CASE WHEN n={n} THEN r END) AS r{n}" for n in SLOTS
)


def _result(n: int) -> str:
    return f"CASE WHEN r{n} IS NOT NULL AND k % 107 = 0 THEN 'MAYBE' ELSE coalesce(r{n}, '') END AS vt_{n}_result"


def _date(n: int) -> str:
    first = "l_orderkey IS NOT NULL AND k % 113 = 0" if n == 1 else "false"
    return f"CASE WHEN {first} THEN '' ELSE coalesce(d{n}, '') END AS vt_{n}_date"


_pairs = ", ".join(f"vt_{n}_date || ',' || vt_{n}_result" for n in SLOTS)
_raw = (
    f"concat_ws(',', {', '.join(_before)}, array_to_string(list_slice([{_pairs}], 1, {_width}), ','), {', '.join(_after)})"
)

# Cases as text fields, with the raw line and its hash.
CASES = f"""
long_attempts AS (
  SELECT *, CASE WHEN l_returnflag = 'A' THEN 'PASS' ELSE 'FAIL' END AS result,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_attempt_order}) AS n
  FROM lineitem),
att AS (
  SELECT l_orderkey, {_slots}
  FROM (SELECT l_orderkey, n, strftime(l_shipdate, '%Y-%m-%d') AS d, result AS r
        FROM long_attempts)
  GROUP BY l_orderkey),
src AS (
  SELECT o_orderkey AS k, o.*, a.*, c.*, strftime(o_orderdate, '%Y-%m-%d') AS od
  FROM orders o LEFT JOIN att a ON o_orderkey = l_orderkey LEFT JOIN customer c ON o_custkey = c_custkey),
wide AS (
  SELECT k, CAST(k // {PART_ROWS} AS INT) AS part, k % {PART_ROWS} + 2 AS source_line,
    CASE WHEN k % 97 = 0 THEN '' WHEN k % 211 = 1 THEN 'LP-' || (k - 1) ELSE 'LP-' || k END AS case_ref,
    CAST(k + 8891 AS VARCHAR) AS isn,
    CASE WHEN k % 103 = 0 THEN '' ELSE 'U.' || coalesce(CAST(c_custkey AS VARCHAR), '') END AS applicant_user_id,
    CASE WHEN c_custkey % 50 = 0 THEN '' ELSE coalesce(c_name, '') END AS applicant_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE coalesce(substr(c_mktsegment, 1, 1), '') END AS permit_category,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS fee_amount,
    CASE WHEN k % 89 = 0 THEN '' WHEN k % 83 = 0 THEN '1998-13-01' WHEN k % 79 = 0 THEN '1998-1-5' ELSE od END AS last_updated,
    CASE WHEN k % 101 = 0 THEN 'SORT OF' WHEN o_orderpriority = '1-URGENT' THEN 'TRUE'
      WHEN o_orderpriority = '2-HIGH' THEN 'Y' WHEN o_orderpriority = '3-MEDIUM' THEN 'FALSE'
      WHEN o_orderpriority = '5-LOW' THEN 'N' ELSE '' END AS fee_paid,
    {', '.join(_date(n) + ', ' + _result(n) for n in SLOTS)},
    CASE WHEN k % 4 = 0 THEN 'B' ELSE '' END AS restr_1, '' AS restr_2,
    CASE WHEN k % 6 = 0 THEN 'G' ELSE '' END AS restr_3,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN k % 109 = 0 THEN 'not-a-date' ELSE od END ELSE '' END AS issued,
    CASE WHEN (o_orderstatus = 'F' AND k % 3 = 0) OR (o_orderstatus = 'O' AND k % 71 = 0)
      THEN strftime(o_orderdate + INTERVAL 1000 DAY, '%Y-%m-%d') ELSE '' END AS expired,
    CASE WHEN o_orderstatus = 'F' AND k % 5 = 0 THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') ELSE '' END AS date_completed
  FROM src),
rec AS (
  SELECT *, 'sha256:' || sha256(raw) AS source_hash
  FROM (SELECT *, {_raw} AS raw FROM wide))"""

_present = {n: f"(vt_{n}_date <> '' OR vt_{n}_result <> '')" for n in SLOTS}

BAD_OCCURRENCE = (
    "coalesce("
    + ", ".join(
        f"CASE WHEN {_present[n]} AND upper(vt_{n}_result) NOT IN ('PASS', 'FAIL') THEN 'ATTEMPT_RESULT:{n}:' || vt_{n}_result "
        f"WHEN {_present[n]} AND ({day(f'vt_{n}_date')}) IS NULL THEN 'ATTEMPT_DATE:{n}:' || vt_{n}_date END"
        for n in SLOTS
    )
    + ")"
)

RULE_SQL = {
    "rule_missing_key": "CASE WHEN case_ref = '' THEN 'MISSING_KEY' END",
    "rule_missing_user": "CASE WHEN applicant_user_id = '' THEN 'MISSING_USER' END",
    "rule_last_updated": "CASE WHEN last_updated = '' THEN 'LAST_UPDATED_MISSING' "
    f"WHEN ({day('last_updated')}) IS NULL THEN 'LAST_UPDATED_UNPARSEABLE:' || last_updated END",
    "rule_bad_boolean": f"CASE WHEN ({flag('fee_paid')}) IS NULL THEN 'FEE_PAID_UNRECOGNISED:' || fee_paid END",
    "rule_bad_dates": "coalesce("
    + ", ".join(
        f"CASE WHEN {c} <> '' AND ({day(c)}) IS NULL THEN 'DATE_UNPARSEABLE:' || {c} END"
        for c in ("issued", "expired", "date_completed")
    )
    + ")",
    "rule_bad_occurrence": BAD_OCCURRENCE,
    "rule_contradictions": "CASE WHEN expired <> '' AND issued = '' THEN 'EXPIRED_WITHOUT_ISSUED' "
    "WHEN date_completed <> '' AND issued = '' THEN 'COMPLETED_WITHOUT_ISSUED' END",
}

_marks = ", ".join(
    f"CASE WHEN ({day(f'vt_{n}_date')}) IS NOT NULL THEN vt_{n}_date || '{n:02d}' || upper(vt_{n}_result) END"
    for n in SLOTS
)
COLLAPSE_SQL = {
    "latest": f"coalesce(substr(greatest({_marks}), 13), 'NONE')",
    "first": f"coalesce(substr(least({_marks}), 13), 'NONE')",
    "any_pass": f"CASE WHEN contains(concat({_marks}), 'PASS') THEN 'PASS' "
    f"WHEN coalesce({_marks}) IS NOT NULL THEN 'FAIL' ELSE 'NONE' END",
}

INPUTS = f"""
valid AS (SELECT *, coalesce({', '.join(RULE_SQL.values())}) AS detail FROM rec),
inputs AS (
  SELECT *, (ok AND date_completed <> '') AS i_c, (ok AND issued <> '') AS i_i, (ok AND expired <> '') AS i_e,
    (ok AND {day('last_updated')} >= {BOUNDARY}) AS i_w, (ok AND {flag('fee_paid')}) AS i_f,
    CASE WHEN ok THEN {COLLAPSE_SQL['latest']} END AS i_v
  FROM (SELECT *, detail IS NULL AS ok FROM valid)),
keyed AS (
  SELECT *, CASE WHEN ok THEN
      (CASE i_v WHEN 'NONE' THEN 0 WHEN 'PASS' THEN 1 ELSE 2 END) + CASE WHEN i_c THEN 3 ELSE 0 END
      + CASE WHEN i_i THEN 6 ELSE 0 END + CASE WHEN i_e THEN 12 ELSE 0 END
      + CASE WHEN i_w THEN 24 ELSE 0 END + CASE WHEN i_f THEN 48 ELSE 0 END END AS cell,
    CASE WHEN ok THEN (CASE WHEN i_c THEN 'C' ELSE 'c' END) || (CASE WHEN i_i THEN 'I' ELSE 'i' END)
      || (CASE WHEN i_e THEN 'E' ELSE 'e' END) || (CASE WHEN i_w THEN 'W' ELSE 'w' END)
      || (CASE WHEN i_f THEN 'F' ELSE 'f' END) || ':' || i_v END AS combination
  FROM inputs)"""

MATCH = (
    "(r.has_date_completed IS NULL OR r.has_date_completed = i_c) AND (r.has_issued IS NULL OR r.has_issued = i_i) "
    "AND (r.has_expired IS NULL OR r.has_expired = i_e) AND (r.within_cutoff IS NULL OR r.within_cutoff = i_w) "
    "AND (r.fee_paid IS NULL OR r.fee_paid = i_f) AND (r.vision_outcome IS NULL OR r.vision_outcome = i_v)"
)

_variables = {
    "applicantName": "applicant_name",
    "permitCategory": "permit_category",
    "feeAmount": "fee_amount",
}
UNSATISFIED = (
    "CASE h_target "
    + " ".join(
        f"WHEN '{target}' THEN {' OR '.join(f'''{_variables[n]} = {chr(39)}{chr(39)}''' for n in names)}"
        for target, names in TARGET_CONTRACT.items()
    )
    + " ELSE false END"
)


def placed(rules: list[tuple], suffix: str = "") -> str:
    """CTEs ``rules``, ``hits``, ``decided`` and ``classified`` for a rule list."""
    s = suffix
    return f"""
rules{s} AS ({rules_values(rules)}),
hits{s} AS (
  SELECT k, r.rule_id, r.position, r.outcome AS h_outcome, r.target_element AS h_target, r.reason_code AS h_reason
  FROM keyed JOIN rules{s} r ON ok AND {MATCH}),
decided{s} AS (
  SELECT k, count(*) AS n_hits, string_agg(rule_id, ',' ORDER BY position) AS rule_ids,
    count(DISTINCT coalesce(h_outcome, '-') || '|' || coalesce(h_target, '-') || '|' || coalesce(h_reason, '-')) AS n_decisions,
    max(h_outcome) AS h_outcome, max(h_target) AS h_target, max(h_reason) AS h_reason
  FROM hits{s} GROUP BY k),
judged{s} AS (
  SELECT keyed.*, n_hits, rule_ids, n_decisions, h_outcome, h_target, h_reason,
    CASE WHEN detail IS NOT NULL THEN 'PREVALIDATION' WHEN n_hits IS NULL THEN 'UNMATCHED'
      WHEN n_decisions > 1 THEN 'AMBIGUOUS'
      WHEN h_outcome = 'MIGRATE' AND (h_target IS NULL OR h_target NOT IN ('vision-assessment', 'cashier-fee-review', 'issuing-review')) THEN 'CITIZEN_TARGET'
      WHEN h_outcome = 'MIGRATE' AND ({UNSATISFIED}) THEN 'CONTRACT_UNSATISFIED' END AS verdict
  FROM keyed LEFT JOIN decided{s} USING (k)),
classified{s} AS (
  SELECT *, CASE WHEN verdict IS NULL THEN h_outcome ELSE 'QUARANTINE' END AS outcome,
    CASE WHEN verdict IS NULL THEN h_target END AS target_element,
    coalesce(verdict, h_reason) AS reason_code,
    verdict IS NULL AND n_hits > 1 AS redundant
  FROM judged{s})"""


WITH_CASES = f"WITH {CASES}"
WITH_INPUTS = f"{WITH_CASES},{INPUTS}"
WITH_CLASSIFIED = f"{WITH_INPUTS},{placed(BASELINE_RULES)}"
WITH_OVERLAP = f"{WITH_INPUTS},{placed(OVERLAP_RULES)}"

# What the run's ledger must look like after one load.
LEDGER = f"""
prior AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN 'CREATED' WHEN k % 11 = 0 THEN 'CREATE_PENDING' WHEN k % 13 = 0 THEN 'RELEASE_FAILED' END AS prior_state
  FROM classified),
planned AS (
  SELECT *, CASE WHEN outcome = 'SKIP' THEN 'RECORD_SKIP' WHEN outcome = 'QUARANTINE' THEN 'RECORD_QUARANTINE'
      WHEN prior_state = 'CREATED' THEN 'ALREADY_LOADED' WHEN prior_state = 'CREATE_PENDING' THEN 'REFUSE_PENDING'
      ELSE 'CREATE' END AS action
  FROM prior),
answered AS (
  SELECT *, CASE WHEN action <> 'CREATE' THEN NULL WHEN k % 5 = 0 THEN 409 WHEN k % 19 = 0 THEN 500 WHEN k % 23 = 0 THEN NULL ELSE 200 END AS code,
    CASE action WHEN 'RECORD_SKIP' THEN 'SKIPPED' WHEN 'RECORD_QUARANTINE' THEN 'QUARANTINED'
      WHEN 'ALREADY_LOADED' THEN 'CREATED' ELSE 'CREATE_PENDING' END AS next_state
  FROM planned),
ledger AS (
  SELECT '{RUN_ID}' AS run_id, k, part, source_line, source_hash, nullif(case_ref, '') AS case_ref,
    CASE WHEN action <> 'CREATE' THEN next_state WHEN code = 200 THEN 'CREATED' WHEN code = 409 THEN 'PENDING_RESOLVED_EXISTS'
      WHEN code = 500 THEN 'CREATE_FAILED' ELSE 'CREATE_PENDING' END AS state,
    CASE WHEN action IN ('ALREADY_LOADED', 'REFUSE_PENDING') THEN 'vision-assessment' ELSE target_element END AS target_element,
    CASE WHEN action NOT IN ('ALREADY_LOADED', 'REFUSE_PENDING') THEN reason_code END AS reason_code,
    CASE WHEN action NOT IN ('ALREADY_LOADED', 'REFUSE_PENDING') AND verdict IS DISTINCT FROM 'PREVALIDATION' THEN rule_ids END AS rule_ids,
    CASE WHEN action IN ('ALREADY_LOADED', 'REFUSE_PENDING') THEN 'EARLIER' WHEN code = 500 THEN 'REJECTED'
      WHEN code = 409 THEN 'DUPLICATE_REFUSED' ELSE detail END AS detail,
    CASE WHEN code = 200 THEN {NEW_KEY} + k WHEN prior_state IN ('CREATED', 'RELEASE_FAILED') THEN {PRIOR_KEY} + k END AS instance_key,
    action, code
  FROM answered),
instances AS (
  SELECT instance_key, case_ref AS business_id, CASE WHEN k % 31 = 0 THEN 'apply-for-permit' ELSE target_element END AS element_id,
    CASE WHEN k % 29 = 0 THEN 'CANCELED' ELSE 'ACTIVE' END AS state
  FROM ledger WHERE instance_key IS NOT NULL
  UNION ALL
  SELECT {ORPHAN_KEY} + k, case_ref, target_element, 'ACTIVE' FROM ledger WHERE instance_key IS NOT NULL AND k % 17 = 0),
active AS (SELECT * FROM instances WHERE state = 'ACTIVE')"""

WITH_LEDGER = f"{WITH_CLASSIFIED},{LEDGER}"

# The event table as a ledger log keyed by user.
USER_EVENTS = """
WITH log AS (
  SELECT 'run-' || (user_id % 3) AS run_id, 0 AS part, user_id + 2 AS source_line,
    CASE event_type WHEN 'signup' THEN 'CLASSIFY' WHEN 'click' THEN 'CONFIRM' ELSE 'TRANSITION' END AS kind,
    CASE WHEN event_type = 'signup' THEN 'sha256:' || sha256(props) END AS source_hash,
    CASE WHEN event_type = 'signup' THEN 'LP-' || user_id END AS case_ref,
    CASE event_type WHEN 'signup' THEN 'CREATE_PENDING' WHEN 'click' THEN 'CREATED' WHEN 'view' THEN 'RELEASE_PENDING'
      WHEN 'purchase' THEN 'RELEASED' ELSE 'RELEASE_FAILED' END AS state,
    CASE WHEN event_type = 'signup' THEN 'element-' || (event_id % 3) END AS target_element,
    CASE WHEN event_type IN ('error', 'signup') AND event_id % 2 = 0 THEN props END AS detail,
    CASE WHEN event_type = 'click' THEN event_id + """ + str(PRIOR_KEY) + """ END AS instance_key,
    epoch_us(ts) AS seq, ts, event_id
  FROM events)"""

EDGES = values([(a, b) for a, targets in ALLOWED_EDGES.items() for b in targets], ["from_state", "to_state"])
BUCKET_OF = "CASE state " + " ".join(f"WHEN '{s}' THEN '{b}'" for s, b in STATE_BUCKETS.items()) + " END"
