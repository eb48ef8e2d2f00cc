import random

import pytest
from pyspark.sql import functions as F

from casegate.operators.ledger import FOLDED, fold_ledger
from casegate.sources.export import source_records
from casegate.streaming import jobs
from tests.samples import GOLDEN, HEADER
from tests.test_ledger import events

SCHEMA = "event_id bigint, business_id string, kind string, at bigint"


def decided(spark, path):
    return {r["event_id"]: r["accepted"] for r in spark.read.parquet(f"{path}/decided").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_keys_are_freed_refused_and_decided_in_order(spark, tmp_path, monkeypatch):
    """Against plain Python, over batches that overlap in time and pass a snapshot."""
    monkeypatch.setattr(jobs, "MERGE_EVERY", 3)
    rng = random.Random(6)
    rows = [(i, f"id-{rng.randrange(6)}", rng.choice(["CREATE", "CREATE", "END"]), 10 * i) for i in range(120)]
    path = str(tmp_path / "unique")
    job = jobs.UniqueActive(spark, SCHEMA, path, lag=100)
    mixed = sorted(rows, key=lambda r: r[3] + rng.randrange(0, 80))
    for batch in range(5):
        part = mixed[batch * 24 : batch * 24 + 24]
        job.work(frame(spark, part), batch)
        if batch == 2:
            before = decided(spark, path)
            job.work(frame(spark, part), batch)  # a repeated batch changes nothing
            assert decided(spark, path) == before
    job.finish()
    last, wanted = {}, {}
    for event_id, key, kind, _ in rows:
        if kind == "CREATE":
            wanted[event_id] = last.get(key) != "CREATE"
        last[key] = kind
    assert decided(spark, path) == wanted and set(wanted.values()) == {True, False}
    assert spark.read.parquet(f"{path}/late").count() == 0
    # The state holds the ids that are active, and no others.
    assert {r[0] for r in job.active_before(6).collect()} == {k for k, kind in last.items() if kind == "CREATE"}


def test_what_comes_too_late_is_kept_apart(spark, tmp_path):
    path = str(tmp_path / "late")
    job = jobs.UniqueActive(spark, SCHEMA, path, lag=5)
    job.work(frame(spark, [(1, "a", "CREATE", 10), (2, "a", "END", 30)]), 0)
    job.work(frame(spark, [(3, "a", "CREATE", 20), (4, "a", "CREATE", 26), (5, "b", "CREATE", 40)]), 1)
    job.work(frame(spark, []), 2)
    job.finish()
    assert {r["event_id"] for r in spark.read.parquet(f"{path}/late").collect()} == {3}
    assert decided(spark, path) == {1: True, 4: False, 5: True}


def test_rows_in_a_final_state_expire_and_go_on_later(spark, tmp_path):
    """Against one fold of the whole log, after every batch; a repeated batch changes nothing."""
    rng = random.Random(3)
    rows = []
    for seq in range(1, 241):
        line = 2 + seq // 12 if rng.random() < 0.9 else rng.randrange(2, 12)
        kind, state = rng.choice([("CLASSIFY", "CLASSIFIED"), ("CONFIRM", "CREATED"), ("TRANSITION", "RELEASED"), ("CLASSIFY", "SKIPPED")])
        rows.append(
            dict(run_id="run", source_line=line, seq=seq, kind=kind, state=state, detail=rng.choice([None, f"d{seq}"]),
                 instance_key=seq if kind == "CONFIRM" else None, target_element="t" if kind == "CLASSIFY" else None)
        )
    for row in {r["source_line"]: r for r in rows}.values():  # in the end every row is released
        row |= dict(kind="TRANSITION", state="RELEASED", instance_key=None, target_element=None)
    job = jobs.LedgerState(spark, str(tmp_path / "state"), ttl=30, merge_every=2)
    live = []
    for batch in range(8):
        part = events(spark, rows[batch * 30 : batch * 30 + 30])
        job.work(part, batch)
        if batch in (3, 4):
            job.work(part, batch)
        whole = fold_ledger(events(spark, rows[: batch * 30 + 30]))
        assert folded(job.current(batch + 1)) == folded(whole)
        live.append(job.live_before(batch + 1).select("source_line").distinct().count())
    last = {r["source_line"]: r for r in rows}
    kept = {line for line, r in last.items() if r["state"] not in jobs.FINAL_STATES or r["seq"] > 240 - 30}
    assert {r["source_line"] for r in job.live_before(8).collect()} == kept
    assert live[-1] < max(live) < len(last), live
    gone = spark.read.parquet(f"{job.path}/final")
    assert gone.count() and {r["state"] for r in gone.select("state").collect()} <= set(jobs.FINAL_STATES)
    # An expired row that went on shows, in the batch, what came since.
    assert gone.groupBy("source_line").count().where("count > 1").count()


def folded(frame):
    return sorted(map(tuple, frame.select(*FOLDED).collect()), key=str)


def test_an_empty_stream_leaves_an_empty_state(spark, tmp_path):
    job = jobs.LedgerState(spark, str(tmp_path / "state"), ttl=1, merge_every=1)
    assert job.current(0).count() == 0
    job.work(events(spark, []), 0)
    assert job.current(1).count() == 0


def test_visibility_is_decided_in_order_and_late_rows_are_reconciled(spark, tmp_path):
    """Against plain Python: batches out of order, keys that are never shown, shown after
    the deadline, shown by a late row, or created too late."""
    rng = random.Random(9)
    timeout, lag = 30, 100
    created = [(i, "CREATED", 10 * i) for i in range(150)]
    shown = [(i, "EXPORTED", at + rng.randrange(0, 60)) for i, _, at in created if i % 7]
    held = {(i, kind) for i, kind, _ in created + shown if i % 11 == (0 if kind == "CREATED" else 5)}
    rest = sorted((r for r in created + shown if r[:2] not in held), key=lambda r: r[2] + rng.randrange(0, 90))
    n = -(-len(rest) // 5)
    batches = [rest[i * n : i * n + n] for i in range(5)] + [[r for r in created + shown if r[:2] in held]]
    job = jobs.VisibilityWatch(spark, str(tmp_path / "watch"), timeout, lag)
    newest, late = None, set()
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, job.SCHEMA)
        job.work(frame, number)
        if number == 2:
            job.work(frame, number)  # a repeated batch changes nothing
        late |= {r[:2] for r in rows if newest is not None and r[2] <= newest - lag}
        newest = max([r[2] for r in rows] + ([newest] if newest is not None else []))
    job.finish()
    at = {i: t for i, _, t in shown}
    wanted = {}
    for i, _, t in created:
        in_time = i in at and (i, "EXPORTED") not in late and at[i] <= t + timeout
        wanted[i] = "late" if (i, "CREATED") in late else "visible" if in_time else "appeared" if i in at else "vanished"
    got = {r["instance_key"]: r["verdict"] for r in job.reconciled().collect()}
    assert got == wanted and set(wanted.values()) == {"late", "visible", "appeared", "vanished"}


def test_creates_without_a_key_or_an_export_vanish(spark, tmp_path):
    job = jobs.VisibilityWatch(spark, str(tmp_path / "watch"), 5, 1)
    job.work(spark.createDataFrame([(None, "CREATED", 1), (None, "EXPORTED", 1), (7, "CREATED", 1), (7, "EXPORTED", 6)], job.SCHEMA), 0)
    job.work(spark.createDataFrame([], job.SCHEMA), 1)
    job.finish()
    assert {r["instance_key"]: r["verdict"] for r in job.reconciled().collect()} == {None: "vanished", 7: "visible"}


def golden_records(spark):
    lines = [(0, i, text) for i, text in enumerate([HEADER, *[g[0] for g in GOLDEN]], start=1)]
    return source_records(spark.createDataFrame(lines, "part int, source_line bigint, raw string"), HEADER)


def boundary():
    return F.to_date(F.lit("2026-03-15"))


def commands(spark, path, batch):
    return {r["source_line"] for r in spark.read.parquet(f"{path}/commands/batch={batch}").collect()}


def test_a_batch_that_died_after_its_plan_is_taken_up_where_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "intent")
    records = golden_records(spark)

    def dies(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(jobs, "create_commands", dies)
        with pytest.raises(RuntimeError, match="executor lost"):
            jobs.intent_first_batch(records, 0, boundary(), "run", path)
    # The plan and its intents are durable, and no command has left.
    intents = spark.read.parquet(f"{path}/intents")
    assert intents.where("state = 'CREATE_PENDING'").count() == 3
    # Repeated, it sends the planned creates, although the run has been closed since.
    jobs.intent_first_batch(records, 0, boundary(), "run", path, closed=lambda: True)
    assert commands(spark, path, 0) == {2, 3, 4}
    assert spark.read.parquet(f"{path}/intents").where("state = 'CREATE_PENDING'").count() == 3
    # The same records again, as another batch, get no second command.
    jobs.intent_first_batch(records, 1, boundary(), "run", path)
    assert commands(spark, path, 1) == set()
    plan = spark.read.parquet(f"{path}/plan/batch=1").where("outcome = 'MIGRATE'")
    assert {r["action"] for r in plan.collect()} == {"REFUSE_PENDING"}


def test_a_closed_run_refuses_creates_and_records_the_rest(spark, tmp_path):
    path = str(tmp_path / "closed")
    jobs.intent_first_batch(golden_records(spark), 0, boundary(), "run", path, closed=lambda: True)
    assert commands(spark, path, 0) == set()
    plan = {r["source_line"]: r["action"] for r in spark.read.parquet(f"{path}/plan").collect()}
    assert {line for line, action in plan.items() if action == "REFUSE_CLOSED"} == {2, 3, 4}
    kept = spark.read.parquet(f"{path}/intents").select("state").distinct().collect()
    assert {r["state"] for r in kept} == {"SKIPPED", "QUARANTINED"}


def test_intents_are_not_dealt_out_by_part_and_only_near_batches_are_read(spark, tmp_path):
    path = str(tmp_path / "wide")
    lines = spark.range(400).select(F.col("id").cast("int").alias("part"), F.lit(2).cast("bigint").alias("source_line"), F.lit(GOLDEN[0][0]).alias("raw"))
    records = source_records(lines, HEADER)
    jobs.intent_first_batch(records.where("part < 300"), 0, boundary(), "run", path)
    jobs.intent_first_batch(records.where("part >= 300"), 1, boundary(), "run", path)
    assert not [p for p in (tmp_path / "wide/intents/batch=0").iterdir() if p.is_dir()]
    assert len([*(tmp_path / "wide/intents/batch=0").glob("*.parquet")]) <= 8
    assert jobs._earlier_in_range(spark, path, 2, 290, 299) == [0]
    assert jobs._earlier_in_range(spark, path, 2, 299, 300) == [0, 1]
    # What lies in the range is known again, whichever batch it came with.
    jobs.intent_first_batch(records.where("part in (0, 299, 399)"), 2, boundary(), "run", path)
    assert {r["action"] for r in spark.read.parquet(f"{path}/plan/batch=2").collect()} == {"REFUSE_PENDING"}
