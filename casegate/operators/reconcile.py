"""Ledger, manifest and instance snapshots against each other: the gate, the
release and abort sets, and the documented correspondence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegate.functions.values import split_permission
from casegate.operators.ledger import BUCKETS, LIVE_STATES, state_to_bucket, with_previous
from casegate.session import broadcast_if_small
from casegate.sources.tables import ledger_events


def _join_key(df: DataFrame) -> Column:
    """Instance key, or a unique negative stand-in, so that rows without a key are
    spread over the shuffle instead of meeting in one task. Lines of a part are
    fewer than 2**32."""
    row = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("source_line").cast("bigint")
    return F.coalesce("instance_key", -1 - row)


def held_not_alive(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Created rows without an active instance, or without any instance key."""
    held = ledger.where("state = 'CREATED'").withColumn("key", _join_key(ledger))
    alive = active.select(F.col("instance_key").alias("key"))
    reason = F.when(F.col("instance_key").isNull(), "NO_INSTANCE_KEY").otherwise("NOT_ACTIVE")
    return held.join(alive, "key", "left_anti").select(
        "run_id", "part", "source_line", "case_ref", "instance_key", reason.alias("reason")
    )


def gate_counts(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Everything the gate needs in one pass and one row: bucket totals, duplicate
    live cases, and held cases that are no longer alive."""
    alive = active.select(F.col("instance_key").alias("key"), F.lit(True).alias("alive")).distinct()
    bucket = state_to_bucket(F.col("state"))
    vanished = (F.col("state") == "CREATED") & F.col("alive").isNull()
    live = F.col("case_ref").isNotNull() & F.col("state").isin(LIVE_STATES)
    per_case = (
        ledger.withColumn("key", _join_key(ledger))
        .join(alive, "key", "left")
        .groupBy("case_ref")
        .agg(
            *[F.count_if(bucket == b).alias(b.lower()) for b in BUCKETS],
            F.count_if(live).alias("n_live"),
            F.count_if(vanished).alias("n_vanished"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return per_case.agg(
        *[F.coalesce(F.sum(b.lower()), zero).alias(b.lower()) for b in BUCKETS],
        F.count_if(F.col("n_live") > 1).alias("duplicates"),
        F.coalesce(F.sum("n_vanished"), zero).alias("vanished"),
    )


def gate_checks(ledger: DataFrame, active: DataFrame, record_count: Column | int) -> DataFrame:
    """Five checks in order, all reported: ``(place, check, n, ok)``. The offending
    rows come whole from ``held_not_alive`` and ``live_duplicates``."""
    return checks_of(gate_counts(ledger, active), record_count)


def checks_of(counts: DataFrame, record_count: Column | int) -> DataFrame:
    """The checks from the one row of ``gate_counts``."""
    expected = F.lit(record_count) if isinstance(record_count, int) else record_count
    total = sum((F.col(b.lower()) for b in BUCKETS[1:]), F.col(BUCKETS[0].lower()))

    def check(place: int, name: str, n: Column) -> Column:
        return F.struct(
            F.lit(place).alias("place"),
            F.lit(name).alias("check"),
            n.cast("bigint").alias("n"),
            (n == 0).alias("ok"),
        )

    return counts.select(
        F.inline(
            F.array(
                check(1, "identity", total - expected),
                check(2, "pending", F.col("pending")),
                check(3, "failed", F.col("failed")),
                check(4, "duplicates", F.col("duplicates")),
                check(5, "vanished", F.col("vanished")),
            )
        )
    )


def gate_block(counts: DataFrame, record_count: Column | int) -> DataFrame:
    """The gate as rows of a report: buckets, their total, what the manifest counted, and
    the verdict with its reasons, each the number of rows that it rests on."""
    expected = F.lit(record_count) if isinstance(record_count, int) else record_count
    bucket = [(b, F.col(b.lower())) for b in BUCKETS]
    total = sum((n for _, n in bucket[1:]), bucket[0][1])
    lines = [*bucket, ("TOTAL", total), ("MANIFEST", expected)]
    row = [F.struct(F.lit("gate").alias("section"), F.lit(k).alias("key"), n.cast("bigint").alias("n")) for k, n in lines]
    checks = checks_of(counts, record_count)
    reasons = checks.where("not ok").select(F.lit("gate failure").alias("section"), F.col("check").alias("key"), "n")
    passed = checks.agg(F.min(F.col("ok").cast("bigint")).alias("n")).select(F.lit("gate").alias("section"), F.lit("PASSED").alias("key"), "n")
    return counts.select(F.inline(F.array(*row))).unionByName(reasons).unionByName(passed)


def gate_passed(checks: DataFrame) -> bool:
    return bool(checks.agg(F.bool_and("ok").alias("ok")).first()["ok"])


def release_plan(ledger: DataFrame, checks: DataFrame) -> DataFrame:
    """Held rows to release, or to count as failed for want of a key; no rows at
    all unless the gate passed (one-row scalar condition)."""
    action = F.when(F.col("instance_key").isNull(), "FAIL_NO_KEY").otherwise("RELEASE")
    held = ledger.where("state = 'CREATED'").withColumn("action", action)
    return ledger.sparkSession.sql(
        "SELECT * FROM {held} WHERE (SELECT bool_and(ok) FROM {checks})", held=held, checks=checks
    )


def abort_allowed(ledger: DataFrame) -> DataFrame:
    """Per run: how many are already released, and whether an abort may start."""
    return ledger.groupBy("run_id").agg(F.count_if(F.col("state") == "RELEASED").alias("n_released")).withColumn(
        "allowed", F.col("n_released") == 0
    )


def known_instances(ledger: DataFrame) -> DataFrame:
    """Instances the ledger knows and an abort would cancel, each with a row that
    names it (the last, should several) and their number."""
    rows = ledger.where("state in ('CREATED', 'RELEASE_PENDING') and instance_key is not null")
    last = F.max(F.struct("part", "source_line")).alias("row")
    named = rows.groupBy("instance_key").agg(last, F.count(F.lit(1)).alias("n_rows"))
    return named.select("instance_key", "row.part", "row.source_line", "n_rows")


def orphan_instances(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Active instances of the run's cases whose key the ledger lost."""
    cases = ledger.where("case_ref is not null").select(F.col("case_ref").alias("business_id"))
    return active.join(cases.distinct(), "business_id", "left_semi").join(
        known_instances(ledger).select("instance_key"), "instance_key", "left_anti"
    )


def abort_set(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """What the ledger knows plus what it lost, once per instance."""
    known = known_instances(ledger).drop("n_rows").withColumn("origin", F.lit("LEDGER"))
    lost = orphan_instances(ledger, active).select("instance_key").distinct().select(
        "instance_key",
        F.lit(None).cast("int").alias("part"),
        F.lit(None).cast("bigint").alias("source_line"),
        F.lit("ORPHAN").alias("origin"),
    )
    return known.unionByName(lost)


def abort_verify(cancelled: DataFrame, later_active: DataFrame) -> DataFrame:
    """After the cancel calls: only what is really gone counts as aborted."""
    alive = later_active.select("instance_key", F.lit(True).alias("alive")).distinct()
    result = (
        F.when(F.col("alive"), "STILL_ACTIVE")
        .when(F.col("source_line").isNotNull(), "ABORTED")
        .otherwise("GONE")
    )
    return cancelled.join(alive, "instance_key", "left").select(
        "instance_key", "part", "source_line", "origin", result.alias("result")
    )


UNRESOLVED = ["CREATE_PENDING", "PENDING_RESOLVED_EXISTS", "PENDING_RESOLVED_ABSENT"]


def resolve_pending(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Creates without a final answer against a snapshot taken after the re-check
    window: ``from_state``, ``n_found``, ``resolution``, ``next_state``, ``instance_key``.

    An instance is a row's own if its case has one active instance that no ledger row
    holds, and one such row. Then the create is confirmed (EXISTS). Without any, an
    unanswered create becomes absent (ABSENT) and an absent one may be tried again
    (RETRY), while one that the engine refused as a duplicate waits to be seen (UNSEEN).
    Several instances or rows of a case (AMBIGUOUS) and rows without a case reference
    (NO_CASE_REF) are left to operators.
    """
    held = ledger.where("instance_key is not null").select("instance_key").distinct()
    free = (
        active.where("business_id is not null")
        .join(held, "instance_key", "left_anti")
        .groupBy(F.col("business_id").alias("case_ref"))
        .agg(F.count_distinct("instance_key").alias("n_found"), F.min("instance_key").alias("found_key"))
    )
    rows = ledger.where(F.col("state").isin(UNRESOLVED)).select(
        "run_id", "part", "source_line", "case_ref", F.col("state").alias("from_state")
    )
    named = rows.where("case_ref is not null")
    counts = named.groupBy("run_id", "case_ref").agg(F.count(F.lit(1)).alias("n_rows"))
    looked_up = named.join(counts, ["run_id", "case_ref"]).join(free, "case_ref", "left")
    # Rows without a case reference have nothing to look up and stay out of the joins.
    nameless = rows.where("case_ref is null").select(
        "*", F.lit(1).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("n_found"), F.lit(None).cast("bigint").alias("found_key")
    )
    found, state = F.coalesce("n_found", F.lit(0).cast("bigint")), F.col("from_state")
    resolution = (
        F.when(F.col("case_ref").isNull(), "NO_CASE_REF")
        .when((F.col("n_rows") > 1) | (found > 1), "AMBIGUOUS")
        .when(found == 1, "EXISTS")
        .when(state == "CREATE_PENDING", "ABSENT")
        .when(state == "PENDING_RESOLVED_ABSENT", "RETRY")
        .otherwise("UNSEEN")
    )
    judged = looked_up.unionByName(nameless).withColumn("resolution", resolution)
    next_state = (
        F.when(F.col("resolution") == "EXISTS", "CREATED")
        .when(F.col("resolution") == "ABSENT", "PENDING_RESOLVED_ABSENT")
        .when(F.col("resolution") == "RETRY", "CREATE_PENDING")
        .otherwise(state)
    )
    return judged.select(
        "run_id", "part", "source_line", "case_ref", "from_state", found.alias("n_found"), "resolution",
        next_state.alias("next_state"), F.when(F.col("resolution") == "EXISTS", F.col("found_key")).alias("instance_key"),
    )


def resolution_events(resolved: DataFrame, first_seq: int) -> DataFrame:
    """Events of the resolutions, by the steps of the state graph: a create that is
    confirmed passes through PENDING_RESOLVED_EXISTS."""

    def event(kind: str, state: str, step: int, key: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(state).alias("state"), F.lit(first_seq + step).alias("seq"),
            (F.lit(None) if key is None else key).cast("bigint").alias("instance_key"),
        )

    again = event("TRANSITION", "CREATE_PENDING", 0)
    exists = event("TRANSITION", "PENDING_RESOLVED_EXISTS", 1)
    created = event("CONFIRM", "CREATED", 2, F.col("instance_key"))
    steps = (
        F.when((F.col("resolution") == "EXISTS") & (F.col("from_state") == "PENDING_RESOLVED_EXISTS"), F.array(created))
        .when((F.col("resolution") == "EXISTS") & (F.col("from_state") == "CREATE_PENDING"), F.array(exists, created))
        .when(F.col("resolution") == "EXISTS", F.array(again, exists, created))
        .when(F.col("resolution") == "ABSENT", F.array(event("TRANSITION", "PENDING_RESOLVED_ABSENT", 0)))
        .when(F.col("resolution") == "RETRY", F.array(again))
    )
    return ledger_events(
        resolved.where(F.col("resolution").isin("EXISTS", "ABSENT", "RETRY"))
        .select("run_id", "part", "source_line", F.explode(steps).alias("step"))
        .select("run_id", "part", "source_line", "step.*")
    )


def correspondence(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Expected against active instances per business id, both directions. Both
    sides are reduced to one row per id first, so a repeated id forms no pairs."""
    expected = (
        ledger.where(F.col("state").isin(LIVE_STATES) & F.col("case_ref").isNotNull())
        .groupBy(F.col("case_ref").alias("business_id"))
        .agg(
            F.count(F.lit(1)).alias("n_expected"),
            F.array_sort(F.collect_set("target_element")).alias("expected"),
        )
    )
    actual = active.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_sort(F.collect_set("element_id")).alias("actual")
    )
    status = (
        F.when(F.col("n_active").isNull(), "missing")
        .when(F.col("n_expected").isNull(), "unexpected")
        .when(F.col("n_active") != F.col("n_expected"), "wrong_count")
        .when(F.col("expected") != F.col("actual"), "wrong_element")
        .otherwise("ok")
    )
    zero = F.lit(0).cast("bigint")
    return expected.join(actual, "business_id", "full_outer").select(
        "business_id",
        F.coalesce("n_expected", zero).alias("n_expected"),
        F.coalesce("n_active", zero).alias("n_active"),
        F.array_join("expected", ",").alias("expected"),
        F.array_join("actual", ",").alias("actual"),
        status.alias("status"),
    )


def cross_run_duplicates(ledger: DataFrame) -> DataFrame:
    """Live rows whose case is also live in another run. Per case only the lowest
    and highest run id are kept, which tells 'another run' without pairing rows."""
    live = ledger.where(F.col("state").isin(LIVE_STATES) & F.col("case_ref").isNotNull())
    spread = (
        live.groupBy("case_ref")
        .agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
        .where("first_run <> last_run")
    )
    return live.join(spread.select("case_ref"), "case_ref", "left_semi").select(
        "run_id", "part", "source_line", "case_ref", "state"
    )


def placement_check(released: DataFrame, groups: DataFrame, tasks: DataFrame) -> DataFrame:
    """Released cases against open tasks: right element, right candidate group.
    ``groups`` is the small (element, group) dimension; tasks are one per instance."""
    expected = released.join(broadcast_if_small(groups), "target_element", "left").select(
        "instance_key",
        F.col("target_element").alias("expected_element"),
        F.col("candidate_group").alias("expected_group"),
        F.lit(True).alias("released"),
    )
    actual = tasks.select(
        "instance_key",
        F.col("element_id").alias("actual_element"),
        F.col("candidate_group").alias("actual_group"),
        F.lit(True).alias("open"),
    )
    status = (
        F.when(F.col("open").isNull(), "no_task")
        .when(F.col("released").isNull(), "not_released")
        .when(F.col("expected_element") != F.col("actual_element"), "wrong_element")
        .when(~F.col("expected_group").eqNullSafe(F.col("actual_group")), "wrong_group")
        .otherwise("ok")
    )
    return expected.join(actual, "instance_key", "full_outer").select(
        "instance_key",
        "expected_element",
        "expected_group",
        "actual_element",
        "actual_group",
        status.alias("status"),
    )


def rule_targets(rules: DataFrame, cells: DataFrame, elements: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every target that a rule names: whether the process model has it, and how many
    records rules send there. ``cells`` are the rules' cells, and ``seen`` the records
    per cell (cell, n); before there is any data it may be left out. A record that
    contradicting rules send to two targets counts at both. All sides are rules, model
    elements and at most 96 cells."""
    targets = rules.where("target_element is not null").select("target_element").distinct()
    known = elements.select("target_element", F.lit(True).alias("in_model")).distinct()
    rows = targets.join(known, "target_element", "left").withColumn("in_model", F.coalesce("in_model", F.lit(False)))
    if seen is None:
        return rows.withColumn("n_records", F.lit(0).cast("bigint"))
    sent = cells.select("target_element", "cell").distinct().join(seen, "cell").groupBy("target_element")
    counted = rows.join(sent.agg(F.sum("n").alias("n_records")), "target_element", "left")
    return counted.withColumn("n_records", F.coalesce("n_records", F.lit(0).cast("bigint")))


def quarantine_queue(ledger: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Quarantined rows with the state an operator's decision leads to. Both ways
    out are written to the ledger; without a decision the row stays."""
    keys = ["run_id", "part", "source_line"]
    rows = ledger.where("state = 'QUARANTINED'").select(
        *keys, "source_hash", "case_ref", "reason_code", "rule_ids"
    )
    decided = rows.join(resolutions.select(*keys, "decision", "chosen_target"), keys, "left")
    next_state = (
        F.when(F.col("decision") == "TARGET", "CREATE_PENDING")
        .when(F.col("decision") == "SKIP", "SKIPPED")
        .otherwise("QUARANTINED")
    )
    target = F.when(F.col("decision") == "TARGET", F.col("chosen_target"))
    return decided.select(
        *keys, "source_hash", "case_ref", "reason_code", "rule_ids",
        next_state.alias("next_state"), target.alias("next_target"),
    )


def permission_map(members: DataFrame, grants: DataFrame, targets: DataFrame) -> DataFrame:
    """User to group to permission to target group. A user can hold one permission
    through several groups, so each result is listed once.

    A permission is read, and looked up among the targets, once for all its holders. It
    comes to a user through the first of the user's groups that holds it, so nothing has
    to be told apart once users and permissions are paired, and a task keeps only the
    groups of the users it is at."""
    held = grants.groupBy("permission").agg(F.collect_set("group_id").alias("holders"))
    names = ["application", "service", "role", "level"]
    wanted = targets.select(*names, "candidate_group").distinct()
    parts = held.select("permission", "holders", *split_permission(F.col("permission")))
    listed = parts.join(broadcast_if_small(wanted), names, "left").select(
        F.explode("holders").alias("group_id"), "permission", "candidate_group", "holders"
    )
    users = members.groupBy("user_id").agg(F.collect_set("group_id").alias("groups"))
    joined = users.select("user_id", "groups", F.explode("groups").alias("group_id")).join(broadcast_if_small(listed), "group_id")
    first = F.array_min(F.array_intersect("groups", "holders")) == F.col("group_id")
    return joined.where((F.size("groups") == 1) | first).select("user_id", "permission", "candidate_group")


def backcheck_sample(classified: DataFrame, n: int, seed: str) -> DataFrame:
    """The same ``n`` records of each outcome for every run, in an order nobody
    chose: by hash of key and seed. The rank filter keeps n rows per map task."""
    mark = F.sha2(F.concat_ws("|", F.col("part"), F.col("source_line"), F.lit(seed)), 256)
    ranked = classified.withColumn("mark", mark).select(
        "outcome",
        "part",
        "source_line",
        "case_ref",
        "target_element",
        "reason_code",
        F.expr("row_number() over (partition by outcome order by mark)").alias("rank"),
    )
    return ranked.where(F.col("rank") <= n)


def unique_active(log: DataFrame, key: str, order: str) -> DataFrame:
    """Creates with whether they are accepted. A key is active after any create,
    accepted or refused, and free after an end; so a create is accepted exactly
    when the event before it is not a create."""
    steps = with_previous(log, [key], order, ["kind"])
    free = F.coalesce(F.col("prev_kind") != "CREATE", F.lit(True))
    return steps.where("kind = 'CREATE'").withColumn("accepted", free)
