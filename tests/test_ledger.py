import random

import pytest
from pyspark.sql import functions as F

from casegate.operators import integrity, ledger, reconcile
from casegate.sources.tables import LEDGER_EVENT_COLUMNS, ledger_events

COLUMNS = list(LEDGER_EVENT_COLUMNS)


def events(spark, rows):
    """Events from dicts; key fields default to one ledger row."""
    schema = ", ".join(f"{n} {t}" for n, t in LEDGER_EVENT_COLUMNS.items())
    full = [tuple({"run_id": "r", "part": 0, "source_line": 2, **row}.get(c) for c in COLUMNS) for row in rows]
    return ledger_events(spark.createDataFrame(full, schema))


def test_fold_follows_upsert_and_coalesce_semantics(spark):
    log = [
        dict(seq=1, kind="CLASSIFY", state="CLASSIFIED", source_hash="h1", case_ref="c1", target_element="t1", detail="d1"),
        dict(seq=2, kind="TRANSITION", state="CREATE_PENDING"),
        dict(seq=3, kind="CONFIRM", state="CREATED", instance_key=7),
        dict(seq=4, kind="TRANSITION", state="RELEASE_FAILED", detail="late"),
    ]
    row = ledger.fold_ledger(events(spark, log)).first()
    assert (row["state"], row["detail"], row["instance_key"], row["target_element"]) == ("RELEASE_FAILED", "late", 7, "t1")
    # A new classification resets the detail even to nothing, but not the key.
    log.append(dict(seq=5, kind="CLASSIFY", state="SKIPPED", source_hash="h2", case_ref="c2"))
    row = ledger.fold_ledger(events(spark, log)).first()
    assert (row["state"], row["detail"], row["instance_key"], row["target_element"]) == ("SKIPPED", None, 7, None)
    assert (row["source_hash"], row["case_ref"]) == ("h1", "c1")
    log.append(dict(seq=6, kind="TRANSITION", state="QUARANTINED"))
    assert ledger.fold_ledger(events(spark, log)).first()["detail"] is None
    # Appending the same events twice changes nothing that is read from it.
    twice = ledger.fold_ledger(events(spark, log + log)).drop("n_events").first()
    assert twice == ledger.fold_ledger(events(spark, log)).drop("n_events").first()


def test_every_state_has_one_bucket(spark):
    assert set(ledger.STATE_BUCKETS.values()) == set(ledger.BUCKETS)
    assert ledger.STATE_BUCKETS["RELEASE_PENDING"] == "PENDING"
    assert ledger.STATE_BUCKETS["ABORTED"] == "ABORTED"
    frame = spark.createDataFrame([(s,) for s in ledger.STATE_BUCKETS], "state string")
    counts = {r["bucket"]: r["n"] for r in ledger.bucket_counts(spark, frame).collect()}
    assert sum(counts.values()) == len(ledger.STATE_BUCKETS)
    assert counts == {"MIGRATED": 2, "SKIPPED": 1, "QUARANTINED": 1, "PENDING": 6, "FAILED": 2, "ABORTED": 1}


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_chained_ranges_equal_plain_windows(spark, ranges):
    """Against brute force, with one key that holds a third of the rows, rows without a
    key, and half of the rows in a burst."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.34 else rng.choice([None, *range(1, 40)])
        seq = i if i < 1500 else 1_000_000 * i
        rows.append((key, seq, rng.choice("abc")))
    frame = spark.createDataFrame(rows, "k int, seq bigint, v string")
    got = ledger.with_previous(frame, ["k"], "seq", ["v"], ranges)
    found = {(r["k"], r["seq"]): (r["position"], r["prev_v"]) for r in got.collect()}
    wanted, last = {}, {}
    for key, seq, value in rows:
        position, previous = last.get(key, (0, None))
        wanted[key, seq] = (position + 1, previous)
        last[key] = (position + 1, value)
    assert found == wanted


def test_a_hot_key_lies_in_many_ranges(spark):
    frame = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), F.lit("a").alias("v"))
    plan = ledger.with_previous(frame, ["k"], "seq", ["v"], 50)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("_range") and "percentile" not in text
    assert plan.agg(F.max("position"), F.count("prev_v")).first() == (4000, 3999)


def test_illegal_transitions(spark):
    good = ["CLASSIFIED", "CREATE_PENDING", "CREATED", "RELEASE_PENDING", "RELEASE_FAILED", "RELEASE_PENDING", "RELEASED"]
    log = [dict(seq=i, kind="TRANSITION", state=s) for i, s in enumerate(good)]
    log += [dict(seq=i, kind="TRANSITION", state=s, source_line=3) for i, s in enumerate(["SKIPPED", "CREATED", "ABORTED"])]
    rows = ledger.illegal_transitions(spark, events(spark, log)).collect()
    assert [(r["source_line"], r["from_state"], r["to_state"]) for r in rows] == [(3, "SKIPPED", "CREATED")]


def folded(spark, rows):
    schema = "run_id string, part int, source_line bigint, case_ref string, state string, target_element string, instance_key bigint"
    return spark.createDataFrame(rows, schema)


def active(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "instance_key bigint")


HELD = [("r", 0, n, f"C-{n}", "CREATED", "t", 100 * n) for n in (1, 2, 3)]
REST = [("r", 0, 10, "C-10", "SKIPPED", None, None), ("r", 0, 11, None, "QUARANTINED", None, None)]


@pytest.mark.parametrize(
    "rows, keys, failing",
    [
        (HELD, [100, 200, 300], set()),
        (HELD, [100, 200], {"vanished"}),
        (HELD[:2] + [(*HELD[2][:6], None)], [100, 200, 300], {"vanished"}),
        ([(*r[:4], "RELEASED", *r[5:]) for r in HELD], [], set()),
        (HELD[:2], [100, 200], {"identity"}),
        (HELD[:2] + [(*HELD[2][:4], "RELEASE_PENDING", "t", 300)], [100, 200], {"pending"}),
        (HELD[:2] + [(*HELD[2][:4], "CREATE_FAILED", "t", None)], [100, 200], {"failed"}),
        (HELD[:2] + [("r", 0, 3, "C-1", "CREATED", "t", 300)], [100, 200, 300], {"duplicates"}),
    ],
)
def test_gate(spark, rows, keys, failing):
    checks = reconcile.gate_checks(folded(spark, rows + REST), active(spark, keys), 5)
    assert {r["check"] for r in checks.collect() if not r["ok"]} == failing
    assert reconcile.gate_passed(checks) is (not failing)
    released = reconcile.release_plan(folded(spark, rows + REST), checks).count()
    assert released == (0 if failing else sum(r[4] == "CREATED" for r in rows))


def test_rows_without_a_key_are_named(spark):
    rows = HELD[:2] + [(*HELD[2][:6], None)]
    gone = reconcile.held_not_alive(folded(spark, rows), active(spark, [100])).collect()
    assert {(r["source_line"], r["reason"]) for r in gone} == {(2, "NOT_ACTIVE"), (3, "NO_INSTANCE_KEY")}


def test_duplicates_across_runs_form_no_pairs(spark):
    rows = [("r1", 0, n, "HOT", "CREATED", "t", n) for n in range(500)]
    rows += [("r2", 0, n, "HOT", "RELEASED", "t", 1000 + n) for n in range(500)]
    rows += [("r1", 0, 900, "ONE", "CREATED", "t", 1), ("r2", 0, 900, "ONE", "SKIPPED", "t", 2)]
    found = reconcile.cross_run_duplicates(folded(spark, rows))
    assert found.count() == 1000
    assert found.where("case_ref <> 'HOT'").count() == 0


def test_unique_active_frees_the_key_after_an_end(spark):
    log = spark.createDataFrame(
        [("a", i, k) for i, k in enumerate(["CREATE", "CREATE", "END", "CREATE", "END", "END", "CREATE"])],
        "key string, at bigint, kind string",
    )
    got = reconcile.unique_active(log, "key", "at").orderBy("at")
    assert [r["accepted"] for r in got.collect()] == [True, False, True, True]


def test_export_changes_pair_by_count(spark):
    old = spark.createDataFrame([("A", "1"), ("B", "1"), ("", "1"), ("", "1"), ("", "2")], "case_ref string, source_hash string")
    new = spark.createDataFrame([("A", "2"), ("C", "1"), ("", "1"), ("", "3")], "case_ref string, source_hash string")
    rows = {r["case_ref"]: tuple(r)[1:] for r in integrity.export_changes(old, new).collect()}
    assert rows == {"A": (1, 0, 0), "B": (0, 0, 1), "C": (0, 1, 0), "": (1, 0, 1)}
