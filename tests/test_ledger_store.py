import random

import pytest
from pyspark.sql import functions as F

from casegate.operators import ledger, reconcile
from casegate.sources.ledger_store import LedgerStore
from casegate.sources.manifest import RunHalted
from casegate.sources.tables import LEDGER_SCHEMA
from tests.test_ledger import events

STATES = [("CLASSIFY", "CLASSIFIED"), ("TRANSITION", "CREATE_PENDING"), ("CONFIRM", "CREATED"), ("TRANSITION", "RELEASE_FAILED"), ("CLASSIFY", "SKIPPED")]


def log(n=300):
    rng = random.Random(11)
    rows = []
    for seq in range(1, n + 1):
        kind, state = rng.choice(STATES)
        rows.append(
            dict(
                run_id=f"run:{rng.randrange(3)}", source_line=rng.randrange(2, 30), seq=seq, kind=kind, state=state,
                source_hash=f"h{seq}" if kind == "CLASSIFY" else None,
                case_ref=rng.choice([None, f"c{seq}"]) if kind == "CLASSIFY" else None,
                target_element=rng.choice([None, "t1", "t2"]), detail=rng.choice([None, None, f"d{seq}"]),
                instance_key=seq if kind == "CONFIRM" else None,
            )
        )
    return rows


def rows_of(frame):
    return sorted(map(tuple, frame.select(*ledger.FOLDED).collect()), key=str)


def test_any_split_of_the_log_folds_to_the_same(spark):
    rows = log()
    whole = rows_of(ledger.fold_ledger(events(spark, rows)))
    for seed in (1, 2):
        rng = random.Random(seed)
        parts = [[] for _ in range(4)]
        for row in rows:
            rng.choice(parts).append(row)
        merged = ledger.merge_partials(ledger.as_partial(events(spark, parts[0])))
        for part in parts[1:]:
            merged = ledger.merge_partials(merged.unionByName(ledger.as_partial(events(spark, part))))
        assert rows_of(merged) == whole


def test_snapshots_follow_the_log(spark, tmp_path):
    rows = log()
    store = LedgerStore(spark, str(tmp_path / "ledger"), merge_every=3)
    assert store.next_seq() == 1 and store.current().count() == 0 and store.settled().count() == 0
    cuts = [0, 40, 41, 150, 151, 230, 300]
    for a, b in zip(cuts, cuts[1:]):
        store.append(events(spark, rows[a:b]))
        want = rows_of(ledger.fold_ledger(events(spark, rows[:b])))
        assert rows_of(store.current()) == want and store.next_seq() == b + 1
    one = [r for r in want if r[0] == "run:1"]
    assert rows_of(store.current("run:1")) == rows_of(store.settled("run:1")) == one
    store.append(spark.createDataFrame([], LEDGER_SCHEMA))
    assert rows_of(store.current()) == rows_of(store.settled()) == want
    assert store.events().count() == 300


def test_half_a_batch_is_never_read(spark, tmp_path):
    """A writer that dies before its commit leaves nothing that readers see."""
    rows = log(60)
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    store.append(events(spark, rows[:20]))
    events(spark, rows[20:60]).write.partitionBy("run_id").parquet(f"{store.path}/log/batch=1")
    again = LedgerStore(spark, store.path)
    assert again.next_seq() == 21 and again.events().count() == 20
    assert rows_of(again.current()) == rows_of(ledger.fold_ledger(events(spark, rows[:20])))
    assert again.append(events(spark, rows[20:30])) == 1
    assert rows_of(again.settled()) == rows_of(ledger.fold_ledger(events(spark, rows[:30])))
    with pytest.raises(RunHalted):
        again._commit("commits/batch=1", [(1, 30, 10)], "batch bigint, last_seq bigint, n_events bigint")


def folds(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("max_by(state")


def test_plans_fold_once_or_not_at_all(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), merge_every=100)
    store.append(events(spark, log(50)))
    store.append(events(spark, log(50)))
    assert folds(store.current()) == 1
    settled = store.settled()
    active = spark.createDataFrame([(1,)], "instance_key bigint").withColumn("business_id", F.lit("x")).withColumn("element_id", F.lit("e"))
    assert folds(settled) == folds(reconcile.cross_run_duplicates(settled)) == folds(reconcile.abort_set(settled, active)) == 0
    checks = reconcile.gate_checks(settled, active, 5)
    assert folds(reconcile.release_plan(settled, checks)) == 0


def test_batches_are_merged_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Each event is dealt to its row's task once; no task sorts more because the session
    asks for few."""
    from casegate.sources import ledger_store

    monkeypatch.setattr(ledger_store, "tasks_for", lambda spark, rows: -(-rows // 10))
    dealt = []
    merge = ledger_store.merge_partials
    monkeypatch.setattr(ledger_store, "merge_partials", lambda partials: dealt.append(partials.rdd.getNumPartitions()) or merge(partials))
    rows = log()
    store = LedgerStore(spark, str(tmp_path / "store"), merge_every=100)
    store.append(events(spark, rows[:200]))
    store.append(events(spark, rows[200:]))
    store.compact()
    assert dealt == [30]
    assert rows_of(store.current()) == rows_of(ledger.fold_ledger(events(spark, rows)))
