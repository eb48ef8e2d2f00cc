"""Queries over the ledger, the load, and the reconciliation of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.catalog import bindings as b
from casegate.catalog import intake
from casegate.catalog import oracle as o
from casegate.catalog.registry import query
from casegate.operators import ledger, load, reconcile
from casegate.sources import tables

KEY = ["part", "source_line"]
ROW = ["run_id", *KEY]
LEDGER_ROW = [
    *ROW, "source_hash", "case_ref", "state", "target_element", "reason_code", "rule_ids", "detail", "instance_key",
]
LIVE_SQL = "state IN ('CREATED', 'RELEASE_PENDING', 'RELEASED')"


def active(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_engine_snapshot(spark, b.snapshot_path(spark, sf), b.PROCESS_ID)


def record_count(spark: SparkSession, sf: str) -> int:
    """What the run row says: the number of cases in the frozen export."""
    return b.table(spark, sf, "orders").count()


def _seq() -> Column:
    """Event time as a number, the order of a user's events."""
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("seq")


# ---- ledger ----------------------------------------------------------------


@query("write_ledger", f"{o.WITH_LEDGER} SELECT {', '.join(LEDGER_ROW)} FROM ledger")
def write_ledger(spark, sf):
    """Events of an earlier load, this load's intents and its answers, appended
    to the log, read back and folded."""
    return b.run_ledger(spark, sf).select(*LEDGER_ROW)


@query(
    "read_ledger",
    f"{o.WITH_LEDGER} SELECT part, source_line, case_ref, target_element, instance_key FROM ledger WHERE state = 'CREATED'",
)
def read_ledger(spark, sf):
    rows = ledger.rows_in_state(b.run_ledger(spark, sf), b.RUN_ID, "CREATED")
    return rows.select(*KEY, "case_ref", "target_element", "instance_key")


@query(
    "rows_in_state",
    f"{o.WITH_LEDGER} SELECT {', '.join(LEDGER_ROW)} FROM ledger WHERE state = 'QUARANTINED'",
)
def rows_in_state(spark, sf):
    return ledger.rows_in_state(b.run_ledger(spark, sf), b.RUN_ID, "QUARANTINED").select(*LEDGER_ROW)


@query(
    "read_engine_snapshot",
    f"{o.WITH_LEDGER} SELECT instance_key, business_id, element_id FROM active",
)
def read_engine_snapshot(spark, sf):
    return active(spark, sf).select("instance_key", "business_id", "element_id")


@query(
    "ledger_fold",
    f"""{o.USER_EVENTS}, last_classify AS (SELECT run_id, source_line, max(seq) AS reset_seq FROM log WHERE kind = 'CLASSIFY' GROUP BY ALL),
    ranked AS (SELECT log.*, coalesce(reset_seq, -1) AS reset,
        row_number() OVER (PARTITION BY run_id, source_line ORDER BY seq DESC) AS back
      FROM log LEFT JOIN last_classify USING (run_id, source_line))
    SELECT run_id, part, source_line,
      arg_min(source_hash, seq) FILTER (WHERE kind = 'CLASSIFY') AS source_hash,
      arg_min(case_ref, seq) FILTER (WHERE kind = 'CLASSIFY') AS case_ref,
      max(state) FILTER (WHERE back = 1) AS state,
      arg_max(target_element, seq) FILTER (WHERE kind = 'CLASSIFY') AS target_element,
      arg_max(detail, seq) FILTER (WHERE detail IS NOT NULL AND seq >= reset) AS detail,
      arg_max(instance_key, seq) FILTER (WHERE instance_key IS NOT NULL) AS instance_key,
      max(seq) AS last_seq, count(*) AS n_events
    FROM ranked GROUP BY run_id, part, source_line""",
)
def ledger_fold(spark, sf):
    """The event table as a log: every trap of the fold occurs in it."""
    return ledger.fold_ledger(b.user_events(spark, sf)).drop("reason_code", "rule_ids")


@query(
    "illegal_transitions",
    f"""{o.USER_EVENTS}, steps AS (SELECT run_id, part, source_line, seq,
        coalesce(lag(state) OVER (PARTITION BY run_id, source_line ORDER BY seq), '-') AS from_state, state AS to_state FROM log),
    edges AS (SELECT * FROM {o.EDGES})
    SELECT * FROM steps WHERE (from_state, to_state) NOT IN (SELECT (from_state, to_state) FROM edges)""",
)
def illegal_transitions(spark, sf):
    """Windows run per range of the log and user, chained over the ranges."""
    return ledger.illegal_transitions(spark, b.user_events(spark, sf))


@query(
    "attempt_sequence",
    f"""WITH log AS (SELECT user_id, ts, event_type IN ('purchase', 'error') AS attempt, event_type FROM events),
    tries AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'PASS' ELSE 'FAIL' END AS result FROM log WHERE attempt),
    seq AS (SELECT *, row_number() OVER w AS position, lag(result) OVER w AS prev FROM tries WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, count(*) AS n_attempts, count(*) FILTER (WHERE prev <> result) AS n_flips,
      min(position) FILTER (WHERE result = 'PASS') - 1 AS before_first_pass FROM seq GROUP BY 1""",
)
def attempt_sequence(spark, sf):
    """Attempts before the first pass, and how often the outcome flips; purchases
    are passes and errors are failures of a user."""
    tries = b.table(spark, sf, "events").where("event_type in ('purchase', 'error')").select(
        "user_id", _seq(), F.when(F.col("event_type") == "purchase", "PASS").otherwise("FAIL").alias("result")
    )
    steps = ledger.with_previous(tries, ["user_id"], "seq", ["result"])
    passed = F.when(F.col("result") == "PASS", F.col("position"))
    return steps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(F.col("prev_result") != F.col("result")).alias("n_flips"),
        (F.min(passed) - 1).alias("before_first_pass"),
    )


@query("state_to_bucket", f"{o.WITH_LEDGER} SELECT part, source_line, state, {o.BUCKET_OF} AS bucket FROM ledger")
def state_to_bucket(spark, sf):
    rows = b.run_ledger(spark, sf)
    return rows.select(*KEY, "state", ledger.state_to_bucket(F.col("state")).alias("bucket"))


_buckets = o.values([(x,) for x in ledger.BUCKETS], ["bucket"])


@query(
    "bucket_counts",
    f"{o.WITH_LEDGER}, placed AS (SELECT {o.BUCKET_OF} AS bucket FROM ledger) "
    f"SELECT v.bucket, count(placed.bucket) AS n FROM {_buckets} LEFT JOIN placed USING (bucket) GROUP BY 1",
)
def bucket_counts(spark, sf):
    return ledger.bucket_counts(spark, b.run_ledger(spark, sf))


_duplicates_sql = (
    f"SELECT run_id, case_ref, count(*) AS n FROM ledger WHERE case_ref IS NOT NULL AND {LIVE_SQL} GROUP BY ALL HAVING count(*) > 1"
)


@query("live_duplicates", f"{o.WITH_LEDGER} {_duplicates_sql}")
def live_duplicates(spark, sf):
    return ledger.live_duplicates(b.run_ledger(spark, sf))


@query("distinct_case_refs", f"{o.WITH_LEDGER} SELECT DISTINCT run_id, case_ref FROM ledger WHERE case_ref IS NOT NULL")
def distinct_case_refs(spark, sf):
    return ledger.distinct_case_refs(b.run_ledger(spark, sf))


# Runs: one per order month, planned again by a later request of the same month.
RUNS_SQL = """
runs AS (
  SELECT strftime(o_orderdate, 'run-%Y-%m') AS run_id, count(*) AS record_count, epoch_us(min(o_orderdate)) AS started_at,
    month(min(o_orderdate)) % 3 = 0 AS creation_closed FROM orders GROUP BY 1),
again AS (SELECT run_id, record_count + 1 AS record_count, started_at + 1 AS started_at, false AS creation_closed FROM runs
  UNION ALL SELECT run_id || '-new', record_count, started_at, false FROM runs WHERE record_count % 2 = 0)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    orders = b.table(spark, sf, "orders")
    started = F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return orders.groupBy(F.date_format("o_orderdate", "'run-'yyyy-MM").alias("run_id")).agg(
        F.count(F.lit(1)).alias("record_count"),
        started.alias("started_at"),
        (F.month(F.min("o_orderdate")) % 3 == 0).alias("creation_closed"),
    )


@query(
    "start_run",
    f"WITH {RUNS_SQL} SELECT * FROM runs UNION ALL SELECT * FROM again WHERE run_id NOT IN (SELECT run_id FROM runs)",
)
def start_run(spark, sf):
    """A repeated start changes nothing; a new one is added."""
    runs = _runs(spark, sf)
    repeated = runs.select(
        "run_id",
        (F.col("record_count") + 1).alias("record_count"),
        (F.col("started_at") + 1).alias("started_at"),
        F.lit(False).alias("creation_closed"),
    )
    new = runs.where("record_count % 2 = 0").select(
        F.concat("run_id", F.lit("-new")).alias("run_id"),
        "record_count",
        "started_at",
        F.lit(False).alias("creation_closed"),
    )
    return ledger.start_run(runs, repeated.unionByName(new))


@query(
    "close_creation",
    f"WITH {RUNS_SQL}, closed AS (SELECT run_id FROM runs WHERE creation_closed OR run_id = 'run-1996-01') "
    "SELECT o_orderkey, strftime(o_orderdate, 'run-%Y-%m') AS run_id FROM orders WHERE strftime(o_orderdate, 'run-%Y-%m') NOT IN (SELECT run_id FROM closed)",
)
def close_creation(spark, sf):
    """Orders that may still be created once one more run is closed."""
    runs = ledger.close_creation(_runs(spark, sf), "run-1996-01")
    batch = b.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "'run-'yyyy-MM").alias("run_id")
    )
    return ledger.open_run_rows(batch, runs).select("o_orderkey", "run_id")


# ---- load ------------------------------------------------------------------


@query(
    "existing_state_join",
    f"{o.WITH_LEDGER} SELECT part, source_line, outcome, prior_state AS existing_state FROM prior",
)
def existing_state_join(spark, sf):
    joined = load.existing_state_join(b.classified(spark, sf), b.prior_ledger(spark, sf))
    return joined.select(*KEY, "outcome", "existing_state")


@query("load_plan", f"{o.WITH_LEDGER} SELECT part, source_line, action, next_state FROM answered")
def load_plan(spark, sf):
    return b.plan_of_load(spark, sf).select(*KEY, "action", "next_state")


@query(
    "apply_create_responses",
    f"{o.WITH_LEDGER} SELECT part, source_line, case_ref AS business_id, code, state, CASE WHEN code = 200 THEN instance_key END AS instance_key "
    "FROM ledger WHERE action = 'CREATE'",
)
def apply_create_responses(spark, sf):
    commands = load.create_commands(b.plan_of_load(spark, sf), b.RUN_ID)
    applied = load.apply_create_responses(commands, b.create_answers(commands))
    return applied.select(*KEY, "business_id", "code", "state", "instance_key")


@query(
    "load_result",
    f"""{o.WITH_LEDGER} SELECT count(*) FILTER (WHERE code = 200) AS created, count(*) FILTER (WHERE action = 'RECORD_SKIP') AS skipped,
    count(*) FILTER (WHERE action = 'RECORD_QUARANTINE') AS quarantined, count(*) FILTER (WHERE action = 'ALREADY_LOADED') AS already_loaded,
    count(*) FILTER (WHERE code = 409) AS already_existed,
    count(*) FILTER (WHERE action = 'REFUSE_PENDING' OR (action = 'CREATE' AND (code IS NULL OR code = 500))) AS failed FROM ledger""",
)
def load_result(spark, sf):
    plan = spark.read.parquet(b.plan_path(spark, sf))
    commands = load.create_commands(plan, b.RUN_ID)
    return load.load_result(plan, load.apply_create_responses(commands, b.create_answers(commands)))


# ---- gate, release, abort --------------------------------------------------

VANISHED_SQL = """
vanished AS (SELECT run_id, part, source_line, case_ref, instance_key,
  CASE WHEN instance_key IS NULL THEN 'NO_INSTANCE_KEY' ELSE 'NOT_ACTIVE' END AS reason
  FROM ledger l WHERE state = 'CREATED' AND NOT EXISTS (SELECT 1 FROM active a WHERE a.instance_key = l.instance_key))"""


@query("held_not_alive", f"{o.WITH_LEDGER},{VANISHED_SQL} SELECT * FROM vanished")
def held_not_alive(spark, sf):
    return reconcile.held_not_alive(b.run_ledger(spark, sf), active(spark, sf))


GATE_SQL = f"""{VANISHED_SQL},
totals AS (SELECT count(*) AS total, count(*) FILTER (WHERE {o.BUCKET_OF} = 'PENDING') AS pending,
  count(*) FILTER (WHERE {o.BUCKET_OF} = 'FAILED') AS failed FROM ledger),
checks AS (
  SELECT 1 AS place, 'identity' AS "check", total - (SELECT count(*) FROM orders) AS n FROM totals
  UNION ALL SELECT 2, 'pending', pending FROM totals
  UNION ALL SELECT 3, 'failed', failed FROM totals
  UNION ALL SELECT 4, 'duplicates', (SELECT count(*) FROM ({_duplicates_sql}))
  UNION ALL SELECT 5, 'vanished', (SELECT count(*) FROM vanished))"""


@query("gate_checks", f"{o.WITH_LEDGER},{GATE_SQL} SELECT *, n = 0 AS ok FROM checks")
def gate_checks(spark, sf):
    return reconcile.gate_checks(b.run_ledger(spark, sf), active(spark, sf), record_count(spark, sf))


@query(
    "gate_identity",
    f"{o.WITH_LEDGER} SELECT (SELECT count(*) FROM ledger) AS total, (SELECT count(*) FROM orders) AS manifest_count, "
    "(SELECT count(*) FROM ledger) = (SELECT count(*) FROM orders) AS ok",
)
def gate_identity(spark, sf):
    """The six buckets add up to what the manifest counted."""
    counts = ledger.bucket_counts(spark, b.run_ledger(spark, sf)).agg(F.sum("n").alias("total"))
    expected = F.lit(record_count(spark, sf)).cast("bigint")
    return counts.select("total", expected.alias("manifest_count"), (F.col("total") == expected).alias("ok"))


def _resolved(frame: DataFrame) -> DataFrame:
    """The ledger after operators dealt with what blocks the gate: open and failed
    rows are back in quarantine, vanished and duplicate instances are aborted."""
    k = b.order_key()
    blocked = b.every(k, 29) | b.every(k, 211) | b.every(k, 211, 1)
    state = (
        F.when(F.col("state").isin("SKIPPED", "QUARANTINED"), F.col("state"))
        .when((F.col("state") == "CREATED") & ~blocked, "CREATED")
        .when(F.col("state") == "CREATED", "ABORTED")
        .otherwise("QUARANTINED")
    )
    return frame.withColumn("state", state)


RESOLVED_SQL = (
    "resolved AS (SELECT * REPLACE (CASE WHEN state IN ('SKIPPED', 'QUARANTINED') THEN state "
    "WHEN state <> 'CREATED' THEN 'QUARANTINED' WHEN k % 29 = 0 OR k % 211 IN (0, 1) THEN 'ABORTED' ELSE state END AS state) FROM ledger)"
)


@query(
    "release_plan",
    f"{o.WITH_LEDGER}, {RESOLVED_SQL} SELECT run_id, part, source_line, instance_key, target_element, "
    "CASE WHEN instance_key IS NULL THEN 'FAIL_NO_KEY' ELSE 'RELEASE' END AS action FROM resolved WHERE state = 'CREATED'",
)
def release_plan(spark, sf):
    """With the blocking rows resolved the gate passes and held rows are released."""
    resolved = _resolved(b.run_ledger(spark, sf))
    checks = reconcile.gate_checks(resolved, active(spark, sf), record_count(spark, sf))
    return reconcile.release_plan(resolved, checks).select(
        *ROW, "instance_key", "target_element", "action"
    )


@query(
    "release_plan_blocked",
    f"{o.WITH_LEDGER},{GATE_SQL} SELECT run_id, part, source_line, instance_key FROM ledger "
    "WHERE state = 'CREATED' AND (SELECT bool_and(n = 0) FROM checks)",
)
def release_plan_blocked(spark, sf):
    """With pending, failed and vanished rows the gate holds everything back."""
    rows = b.run_ledger(spark, sf)
    checks = reconcile.gate_checks(rows, active(spark, sf), record_count(spark, sf))
    return reconcile.release_plan(rows, checks).select(*ROW, "instance_key")


RESOLVE_SQL = """
waiting AS (SELECT run_id, part, source_line, case_ref, k, CASE WHEN state = 'CREATE_PENDING' AND k % 2 = 0 THEN 'PENDING_RESOLVED_ABSENT' ELSE state END AS from_state
  FROM ledger WHERE state IN ('CREATE_PENDING', 'PENDING_RESOLVED_EXISTS', 'PENDING_RESOLVED_ABSENT')),
later AS (SELECT instance_key, business_id FROM active
  UNION ALL SELECT 7000000000 + k, case_ref FROM waiting WHERE k % 3 = 0 UNION ALL SELECT 8000000000 + k, case_ref FROM waiting WHERE k % 21 = 0),
free AS (SELECT business_id AS case_ref, count(DISTINCT instance_key) AS found, min(instance_key) AS found_key FROM later
  WHERE business_id IS NOT NULL AND instance_key NOT IN (SELECT instance_key FROM ledger WHERE instance_key IS NOT NULL) GROUP BY 1),
counted AS (SELECT run_id, case_ref, count(*) AS n_rows FROM waiting GROUP BY ALL),
resolutions AS (SELECT w.*, coalesce(found, 0) AS n_found, found_key,
    CASE WHEN w.case_ref IS NULL THEN 'NO_CASE_REF' WHEN n_rows > 1 OR found > 1 THEN 'AMBIGUOUS' WHEN found = 1 THEN 'EXISTS'
      WHEN from_state = 'CREATE_PENDING' THEN 'ABSENT' WHEN from_state = 'PENDING_RESOLVED_ABSENT' THEN 'RETRY' ELSE 'UNSEEN' END AS resolution
  FROM waiting w LEFT JOIN counted c ON w.run_id = c.run_id AND w.case_ref = c.case_ref LEFT JOIN free f ON w.case_ref = f.case_ref)"""


@query(
    "resolve_pending",
    f"{o.WITH_LEDGER},{RESOLVE_SQL} SELECT run_id, part, source_line, case_ref, from_state, n_found, resolution, "
    "CASE resolution WHEN 'EXISTS' THEN 'CREATED' WHEN 'ABSENT' THEN 'PENDING_RESOLVED_ABSENT' WHEN 'RETRY' THEN 'CREATE_PENDING' ELSE from_state END AS next_state, "
    "CASE WHEN resolution = 'EXISTS' THEN found_key END AS instance_key FROM resolutions",
)
def resolve_pending(spark, sf):
    """Half of the unanswered creates were found absent once; in a later snapshot a
    third of all cases that wait have an instance, and some have two."""
    k = b.order_key()
    absent = (F.col("state") == "CREATE_PENDING") & b.every(k, 2)
    rows = b.run_ledger(spark, sf).withColumn("state", F.when(absent, "PENDING_RESOLVED_ABSENT").otherwise(F.col("state")))
    waiting = rows.where(F.col("state").isin(reconcile.UNRESOLVED))

    def seen(step: int, base: int) -> DataFrame:
        return waiting.where(b.every(k, step)).select((k + base).alias("instance_key"), F.col("case_ref").alias("business_id"))

    later = active(spark, sf).select("instance_key", "business_id").unionByName(seen(3, 7_000_000_000)).unionByName(seen(21, 8_000_000_000))
    return reconcile.resolve_pending(rows, later)


@query(
    "abort_guard",
    f"{o.USER_EVENTS}, state_of AS (SELECT run_id, source_line, arg_max(state, seq) AS state FROM log GROUP BY ALL) "
    "SELECT run_id, count(*) FILTER (WHERE state = 'RELEASED') AS n_released, count(*) FILTER (WHERE state = 'RELEASED') = 0 AS allowed "
    "FROM (SELECT * FROM state_of UNION ALL SELECT 'held-' || run_id, source_line, state FROM state_of WHERE state <> 'RELEASED') GROUP BY 1",
)
def abort_guard(spark, sf):
    """Every run as it stands, and as it stood without its released rows."""
    rows = ledger.fold_ledger(b.user_events(spark, sf))
    held = rows.where("state <> 'RELEASED'").withColumn("run_id", F.concat(F.lit("held-"), "run_id"))
    return reconcile.abort_allowed(rows.unionByName(held))


ABORT_SQL = """
known AS (SELECT instance_key, part, source_line FROM ledger WHERE state IN ('CREATED', 'RELEASE_PENDING') AND instance_key IS NOT NULL),
orphans AS (SELECT instance_key, business_id, element_id FROM active WHERE business_id IN (SELECT case_ref FROM ledger WHERE case_ref IS NOT NULL)
  AND instance_key NOT IN (SELECT instance_key FROM known)),
to_cancel AS (SELECT instance_key, part, source_line, 'LEDGER' AS origin FROM known
  UNION ALL SELECT DISTINCT instance_key, CAST(NULL AS INT), CAST(NULL AS BIGINT), 'ORPHAN' FROM orphans)"""


@query("orphan_instances", f"{o.WITH_LEDGER},{ABORT_SQL} SELECT * FROM orphans")
def orphan_instances(spark, sf):
    return reconcile.orphan_instances(b.run_ledger(spark, sf), active(spark, sf)).select(
        "instance_key", "business_id", "element_id"
    )


@query("abort_set", f"{o.WITH_LEDGER},{ABORT_SQL} SELECT * FROM to_cancel")
def abort_set(spark, sf):
    return reconcile.abort_set(b.run_ledger(spark, sf), active(spark, sf))


@query(
    "abort_verify",
    f"{o.WITH_LEDGER},{ABORT_SQL}, later AS (SELECT instance_key FROM active WHERE instance_key % 61 = 0) "
    "SELECT instance_key, part, source_line, origin, CASE WHEN instance_key IN (SELECT instance_key FROM later) THEN 'STILL_ACTIVE' "
    "WHEN source_line IS NOT NULL THEN 'ABORTED' ELSE 'GONE' END AS result FROM to_cancel",
)
def abort_verify(spark, sf):
    """A later snapshot in which some cancelled instances are still active."""
    now = active(spark, sf)
    later = now.where(F.col("instance_key") % 61 == 0)
    return reconcile.abort_verify(reconcile.abort_set(b.run_ledger(spark, sf), now), later)


# ---- documented checks -----------------------------------------------------


@query(
    "correspondence",
    f"""{o.WITH_LEDGER},
    wanted AS (SELECT case_ref AS business_id, count(*) AS n_expected, string_agg(DISTINCT target_element, ',' ORDER BY target_element) AS expected
      FROM ledger WHERE {LIVE_SQL} AND case_ref IS NOT NULL GROUP BY 1),
    found AS (SELECT business_id, count(*) AS n_active, string_agg(DISTINCT element_id, ',' ORDER BY element_id) AS actual FROM active GROUP BY 1)
    SELECT coalesce(w.business_id, f.business_id) AS business_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_active, 0) AS n_active,
      expected, CASE WHEN f.n_active IS NOT NULL THEN coalesce(actual, '') END AS actual,
      CASE WHEN n_active IS NULL THEN 'missing' WHEN n_expected IS NULL THEN 'unexpected' WHEN n_active <> n_expected THEN 'wrong_count'
        WHEN expected <> actual THEN 'wrong_element' ELSE 'ok' END AS status
    FROM wanted w FULL JOIN found f ON w.business_id = f.business_id""",
)
def correspondence(spark, sf):
    return reconcile.correspondence(b.run_ledger(spark, sf), active(spark, sf))


@query(
    "cross_run_duplicates",
    f"{o.WITH_LEDGER}, runs AS (SELECT run_id, part, source_line, case_ref, state FROM ledger "
    "UNION ALL SELECT 'run-2', part, source_line, case_ref, state FROM ledger WHERE k % 3 = 0), "
    f"live AS (SELECT * FROM runs WHERE {LIVE_SQL} AND case_ref IS NOT NULL) "
    "SELECT * FROM live WHERE case_ref IN (SELECT case_ref FROM live GROUP BY 1 HAVING count(DISTINCT run_id) > 1)",
)
def cross_run_duplicates(spark, sf):
    return reconcile.cross_run_duplicates(b.two_runs(spark, sf))


# The candidate group of each back-office element.
CANDIDATE_GROUPS = {
    "vision-assessment": "civil-servant",
    "cashier-fee-review": "cashier",
    "issuing-review": "issuing-officer",
}
_groups_sql = o.values(list(CANDIDATE_GROUPS.items()), ["target_element", "candidate_group"])


@query(
    "placement_check",
    f"""{o.WITH_LEDGER}, groups AS (SELECT * FROM {_groups_sql}),
    released AS (SELECT instance_key, l.target_element AS expected_element, candidate_group AS expected_group
      FROM ledger l LEFT JOIN groups g USING (target_element) WHERE state = 'CREATED' AND instance_key IS NOT NULL),
    tasks AS (SELECT instance_key, element_id AS actual_element,
        CASE WHEN instance_key % 19 = 0 THEN 'cashier' ELSE candidate_group END AS actual_group
      FROM active LEFT JOIN groups ON element_id = target_element)
    SELECT coalesce(r.instance_key, t.instance_key) AS instance_key, expected_element, expected_group, actual_element, actual_group,
      CASE WHEN t.instance_key IS NULL THEN 'no_task' WHEN r.instance_key IS NULL THEN 'not_released'
        WHEN expected_element <> actual_element THEN 'wrong_element' WHEN expected_group IS DISTINCT FROM actual_group THEN 'wrong_group' ELSE 'ok' END AS status
    FROM released r FULL JOIN tasks t ON r.instance_key = t.instance_key""",
)
def placement_check(spark, sf):
    rows = ", ".join(f"('{e}', '{g}')" for e, g in CANDIDATE_GROUPS.items())
    groups = spark.sql(f"SELECT * FROM VALUES {rows} AS t(target_element, candidate_group)")
    released = b.run_ledger(spark, sf).where("state = 'CREATED' and instance_key is not null")
    group = F.when(F.col("instance_key") % 19 == 0, "cashier").otherwise(F.col("candidate_group"))
    tasks = active(spark, sf).join(
        groups, F.col("element_id") == F.col("target_element"), "left"
    ).select("instance_key", "element_id", group.alias("candidate_group"))
    return reconcile.placement_check(released, groups, tasks)


@query(
    "quarantine_queue",
    f"{o.WITH_LEDGER} SELECT run_id, part, source_line, source_hash, case_ref, reason_code, rule_ids, "
    "CASE WHEN k % 3 = 0 THEN 'CREATE_PENDING' WHEN k % 5 = 0 THEN 'SKIPPED' ELSE 'QUARANTINED' END AS next_state, "
    "CASE WHEN k % 3 = 0 THEN 'vision-assessment' END AS next_target FROM ledger WHERE state = 'QUARANTINED'",
)
def quarantine_queue(spark, sf):
    """Open quarantine rows with the decisions operators have taken on some."""
    rows = b.run_ledger(spark, sf)
    k = b.order_key()
    decision = F.when(b.every(k, 3), "TARGET").when(b.every(k, 5), "SKIP")
    resolutions = b.cases(spark, sf).select(
        F.lit(b.RUN_ID).alias("run_id"),
        *KEY,
        decision.alias("decision"),
        F.when(b.every(k, 3), "vision-assessment").alias("chosen_target"),
    )
    return reconcile.quarantine_queue(rows, resolutions.where("decision is not null"))


@query(
    "permission_map",
    f"""WITH members AS (SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer),
    grants AS (SELECT DISTINCT c_nationkey AS group_id, {intake.PERMISSION_SQL} AS permission FROM customer),
    held AS (SELECT DISTINCT user_id, permission FROM members JOIN grants USING (group_id))
    SELECT user_id, permission, CASE split_part(permission, '.', 3) || split_part(permission, '.', 4)
      WHEN 'building1' THEN 'civil-servant' WHEN 'machinery2' THEN 'cashier' WHEN 'furniture3' THEN 'issuing-officer' END AS candidate_group FROM held""",
)
def permission_map(spark, sf):
    """Customers are users, nations are groups, and groups hold the permissions."""
    customer = b.table(spark, sf, "customer")
    members = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    grants = customer.select(
        F.col("c_nationkey").alias("group_id"), intake._permission().alias("permission")
    ).distinct()
    pairs = [("building", "1", "civil-servant"), ("machinery", "2", "cashier"), ("furniture", "3", "issuing-officer")]
    rows = ", ".join(
        f"('12', '{service}', '{role}', '{level}', '{group}')"
        for service in range(5)
        for role, level, group in pairs
    )
    targets = spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(application, service, role, level, candidate_group)"
    )
    return reconcile.permission_map(members, grants, targets)


@query(
    "unique_active",
    """WITH log AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('signup', 'purchase')),
    seq AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM log)
    SELECT event_id, user_id, coalesce(prev, 'purchase') <> 'signup' AS accepted FROM seq WHERE event_type = 'signup'""",
)
def unique_active(spark, sf):
    """A signup creates an instance, a purchase ends it; a create while one is
    active is refused, and an ended instance frees its business id."""
    log = b.table(spark, sf, "events").where("event_type in ('signup', 'purchase')").select(
        "event_id",
        "user_id",
        _seq(),
        F.when(F.col("event_type") == "signup", "CREATE").otherwise("END").alias("kind"),
    )
    decided = reconcile.unique_active(log, "user_id", "seq")
    return decided.select("event_id", "user_id", "accepted")
