"""Whole runs over files: freeze, classify, load, answers, gate, release, abort."""

import pytest
from pyspark.sql import functions as F

from casegate.operators.integrity import expectation_diff, expectation_summary
from casegate.operators.ledger import rows_in_state
from casegate.plans import run as plans
from casegate.plans.classify import dry_run, halt_on_expectation
from casegate.sources import export, manifest, rules
from casegate.sources.expectations import scan_expectations
from casegate.sources.tables import read_engine_snapshot
from tests.samples import GOLDEN, HEADER

RUN = "run-golden"


def freeze(spark, folder, lines=None, header=HEADER):
    """Write an export and the manifest that freezes it."""
    lines = [g[0] for g in GOLDEN] if lines is None else lines
    folder.mkdir(parents=True, exist_ok=True)
    source = folder / "export.csv"
    source.write_text("\n".join([header, *lines]) + "\n")
    numbered = export.number_lines(export.read_lines(spark, str(source)))
    rows = manifest.build_manifest_lines(
        export.source_records(numbered, header), export.header_hashes(numbered), RUN, "2026-09-15", 6
    )
    target = folder / "manifest.csv"
    texts = [r["raw"] for r in rows.orderBy("at").collect()]
    target.write_text("# frozen\n\nextra=ignored\n" + "\n".join(texts) + "\n")
    return str(source), str(target)


def expectations(folder, changes=None):
    path = folder / "expected.csv"
    rows = ["# by hand", "SOURCE_LINE,CASE_REF,EXPECTED_OUTCOME,EXPECTED_TARGET_ELEMENT,EXPECTED_REASON_CODE,WHY"]
    for i, (_, outcome, target, reason) in enumerate(GOLDEN):
        outcome = (changes or {}).get(i + 2, outcome)
        rows.append(f"{i + 2},,{outcome},{target or ''},{reason or ''},because, as said, of this")
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_all_thirteen_golden_cases(spark, tmp_path):
    run = dry_run(spark, *freeze(spark, tmp_path))
    expected = scan_expectations(spark, expectations(tmp_path))
    assert expectation_diff(run.classified, expected).collect() == []
    summary = expectation_summary(run.classified, expected).first()
    assert (summary["checked"], summary["passed"]) == (13, True)
    assert {r["outcome"]: r["count"] for r in run.classified.groupBy("outcome").count().collect()} == {
        "MIGRATE": 3, "SKIP": 4, "QUARANTINE": 6,
    }
    assert run.parameters.record_count == 13 and run.parameters.run_id == RUN


def test_expectation_mismatch_halts(spark, tmp_path):
    run = dry_run(spark, *freeze(spark, tmp_path))
    wrong = scan_expectations(spark, expectations(tmp_path, {4: "SKIP"}))
    rows = expectation_diff(run.classified, wrong).collect()
    assert [(r["source_line"], r["field"], r["expected"], r["actual"]) for r in rows] == [
        (4, "outcome", "SKIP", "MIGRATE")
    ]
    with pytest.raises(manifest.RunHalted):
        halt_on_expectation(run.classified, wrong)


@pytest.mark.parametrize("damage", ["row", "header", "missing", "added", "count"])
def test_a_changed_source_halts(spark, tmp_path, damage):
    source, frozen = freeze(spark, tmp_path)
    text = open(source).read()
    lines = text.splitlines()
    if damage == "row":
        lines[3] += " "
    elif damage == "header":
        lines[0] = lines[0].replace("FEE_PAID", "FEE_PAYED")
    elif damage == "missing":
        lines.pop()
    elif damage == "added":
        lines.append(lines[-1])
    else:
        body = open(frozen).read().replace("recordCount=13", "recordCount=12")
        open(frozen, "w").write(body)
    open(source, "w").write("\n".join(lines) + "\n")
    with pytest.raises(manifest.RunHalted):
        dry_run(spark, source, frozen)


@pytest.mark.parametrize("key", ["freezeDate", "cutoffMonths", "runId", "recordCount", "headerHash"])
def test_manifest_needs_every_parameter(spark, tmp_path, key):
    source, frozen = freeze(spark, tmp_path)
    body = "\n".join(l for l in open(frozen).read().splitlines() if not l.startswith(key))
    open(frozen, "w").write(body + "\n")
    with pytest.raises(manifest.RunHalted):
        dry_run(spark, source, frozen)


def snapshot(spark, folder, rows):
    schema = "instance_key bigint, process_id string, business_id string, element_id string, state string"
    path = str(folder)
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return read_engine_snapshot(spark, path, "p")


def answers(spark, rows):
    schema = "part int, source_line bigint, code int, message string, instance_key bigint"
    return spark.createDataFrame(rows, schema)


def states(store):
    return {r["source_line"]: r["state"] for r in store.ledger(RUN).collect()}


def loaded(spark, tmp_path, rows):
    store = plans.RunStore(spark, str(tmp_path / "run"))
    source, frozen = freeze(spark, tmp_path)
    run, commands = plans.migrate(store, source, frozen, scan_expectations(spark, expectations(tmp_path)))
    plans.record_responses(store, RUN, commands, answers(spark, rows))
    return store, run, commands


OK = [(0, 2, 200, None, 102), (0, 3, 200, None, 103), (0, 4, 200, None, 104)]
ALIVE = [(n, "p", f"G-0{n - 101}", "x", "ACTIVE") for n in (102, 103, 104)]


def test_load_gate_release(spark, tmp_path):
    store, run, commands = loaded(spark, tmp_path, OK)
    found = {r["source_line"]: r for r in commands.collect()}
    assert sorted(found) == [2, 3, 4]
    assert found[3]["payload"] == {
        "legacyId": "G-02", "runId": RUN, "targetElementId": "cashier-fee-review",
        "legacyStarterId": "U.02", "applicantName": "Some Body", "feeAmount": "31.50",
    }
    # A second load creates nothing and forgets nothing.
    assert plans.load_intents(store, run).count() == 0
    assert [states(store)[n] for n in (2, 3, 4)] == ["CREATED"] * 3
    assert {r["instance_key"] for r in store.ledger(RUN).collect()} == {None, 102, 103, 104}

    active = snapshot(spark, tmp_path / "snap", ALIVE)
    checks = plans.gate(store, RUN, active)
    assert all(r["ok"] for r in checks.collect())
    with pytest.raises(manifest.RunHalted):
        plans.load_intents(store, run)

    released = plans.release_intents(store, RUN, checks)
    assert sorted(r["instance_key"] for r in released.collect()) == [102, 103, 104]
    plans.record_releases(
        store, RUN,
        spark.createDataFrame(
            [(0, 2, True, None), (0, 3, False, "no such element")],
            "part int, source_line bigint, ok boolean, message string",
        ),
    )
    now = states(store)
    assert (now[2], now[3], now[4]) == ("RELEASED", "RELEASE_FAILED", "RELEASE_PENDING")
    assert rows_in_state(store.ledger(RUN), RUN, "RELEASE_FAILED").first()["detail"] == "no such element"
    with pytest.raises(manifest.RunHalted):
        plans.abort(store, RUN, active)


def test_unanswered_create_blocks_and_is_never_repeated(spark, tmp_path):
    store, run, _ = loaded(spark, tmp_path, OK[:1] + [(0, 3, 409, None, None)])
    now = states(store)
    assert (now[2], now[3], now[4]) == ("CREATED", "PENDING_RESOLVED_EXISTS", "CREATE_PENDING")
    again = plans.load_intents(store, run)
    # Only the refused duplicate is planned again; the unanswered create is not.
    assert [r["source_line"] for r in again.collect()] == [3]
    checks = {r["check"]: r for r in plans.gate(store, RUN, snapshot(spark, tmp_path / "s", ALIVE)).collect()}
    assert checks["pending"]["n"] == 2 and not checks["pending"]["ok"]
    assert checks["identity"]["ok"]
    assert plans.release_intents(store, RUN, plans.gate(store, RUN, snapshot(spark, tmp_path / "s2", ALIVE))).count() == 0


def test_unanswered_creates_are_resolved_and_tried_again(spark, tmp_path):
    store, run, commands = loaded(spark, tmp_path, [(0, 3, 409, None, None)])
    # Line 2 turns up in the snapshot, line 3 is seen, line 4 is not.
    resolved, again = plans.resolve_creates(store, RUN, snapshot(spark, tmp_path / "s", ALIVE[:2]))
    assert {r["source_line"]: r["resolution"] for r in resolved.collect()} == {2: "EXISTS", 3: "EXISTS", 4: "ABSENT"}
    assert again.count() == 0
    now = {r["source_line"]: (r["state"], r["instance_key"]) for r in store.ledger(RUN).collect() if r["source_line"] < 5}
    assert now == {2: ("CREATED", 102), 3: ("CREATED", 103), 4: ("PENDING_RESOLVED_ABSENT", None)}
    resolved, again = plans.resolve_creates(store, RUN, snapshot(spark, tmp_path / "s2", ALIVE[:2]))
    assert [r["resolution"] for r in resolved.collect()] == ["RETRY"]
    first = {r["source_line"]: r for r in commands.collect()}
    assert again.collect() == [first[4]]
    assert states(store)[4] == "CREATE_PENDING"
    # Its answer counts once; an answer to a row that was confirmed is refused.
    answer = answers(spark, [(0, 4, 200, None, 104), (0, 2, 500, "late", None)])
    refused = plans.record_responses(store, RUN, commands, answer)
    assert [(r["source_line"], r["from_state"], r["state"]) for r in refused.collect()] == [(2, "CREATED", "CREATE_FAILED")]
    assert plans.record_responses(store, RUN, commands, answer).count() == 2
    checks = plans.gate(store, RUN, snapshot(spark, tmp_path / "s3", ALIVE))
    assert all(r["ok"] for r in checks.collect())


def test_vanished_instance_blocks_the_gate(spark, tmp_path):
    store, *_ = loaded(spark, tmp_path, OK)
    gone = [(102, "p", "G-01", "x", "ACTIVE"), (103, "p", "G-02", "x", "CANCELED"), (104, "q", "G-03", "x", "ACTIVE")]
    checks = {r["check"]: r["n"] for r in plans.gate(store, RUN, snapshot(spark, tmp_path / "s", gone)).collect()}
    assert checks == {"identity": 0, "pending": 0, "failed": 0, "duplicates": 0, "vanished": 2}


def test_abort_finds_orphans_and_trusts_only_what_is_gone(spark, tmp_path):
    store, *_ = loaded(spark, tmp_path, OK[:2])
    orphan = (999, "p", "G-03", "x", "ACTIVE")
    stranger = (555, "p", "someone else", "x", "ACTIVE")
    active = snapshot(spark, tmp_path / "s", ALIVE[:2] + [orphan, stranger])
    wanted = plans.abort(store, RUN, active)
    assert {(r["instance_key"], r["origin"]) for r in wanted.collect()} == {
        (102, "LEDGER"), (103, "LEDGER"), (999, "ORPHAN"),
    }
    later = snapshot(spark, tmp_path / "later", [ALIVE[1]])
    result = plans.record_aborts(store, RUN, wanted, later)
    assert {r["instance_key"]: r["result"] for r in result.collect()} == {
        102: "ABORTED", 103: "STILL_ACTIVE", 999: "GONE",
    }
    now = states(store)
    assert (now[2], now[3], now[4]) == ("ABORTED", "CREATED", "CREATE_PENDING")


def test_a_run_nobody_started_is_open(spark, tmp_path):
    store = plans.RunStore(spark, str(tmp_path / "none"))
    assert store.is_closed("x") is False
    assert store.ledger("x").count() == 0


def test_restarting_keeps_the_first_run_row(spark, tmp_path):
    store = plans.RunStore(spark, str(tmp_path / "r"))
    p = dry_run(spark, *freeze(spark, tmp_path)).parameters
    store.start(p, "rules-1")
    store.close(RUN)
    store.start(plans.RunParameters(RUN, p.freeze_date, 99, "other", 1), "rules-2")
    row = store.run(RUN).first()
    assert (row["cutoff_months"], row["record_count"], row["creation_closed"]) == (6, 13, True)
    assert row["rules_hash"] == "rules-1"
    assert store.run(RUN).select(F.col("started_at").isNotNull().alias("x")).first()["x"]


def test_a_run_cannot_resume_under_another_rule_table(spark, tmp_path):
    store, *_ = loaded(spark, tmp_path, OK)
    source, frozen = str(tmp_path / "export.csv"), str(tmp_path / "manifest.csv")
    other = dry_run(spark, source, frozen, rules.overlap_rules(spark))
    with pytest.raises(manifest.RunHalted, match="another rule table"):
        plans.load_intents(store, other)


def test_quarantine_has_two_ways_out(spark, tmp_path):
    store, *_ = loaded(spark, tmp_path, OK)
    decisions = spark.createDataFrame(
        [(RUN, 0, 10, "TARGET", "vision-assessment"), (RUN, 0, 9, "SKIP", None), (RUN, 0, 5, "SKIP", None)],
        "run_id string, part int, source_line bigint, decision string, chosen_target string",
    )
    refused, commands = plans.record_resolutions(store, RUN, decisions)
    assert refused.count() == 0
    (command,) = commands.collect()
    assert (command["source_line"], command["target_element"]) == (10, "vision-assessment")
    assert command["payload"]["applicantName"] and command["payload"]["targetElementId"] == "vision-assessment"
    rows = {r["source_line"]: r for r in store.ledger(RUN).collect()}
    assert (rows[10]["state"], rows[10]["target_element"], rows[10]["reason_code"]) == (
        "CREATE_PENDING", "vision-assessment", "UNMATCHED",
    )
    assert (rows[9]["state"], rows[11]["state"]) == ("SKIPPED", "QUARANTINED")
    # Line 5 was never in quarantine: a decision on it changes nothing.
    assert rows[5]["last_seq"] < rows[9]["last_seq"]


def test_a_chosen_target_needs_its_variables(spark, tmp_path):
    """A case without the variables of the chosen target stays in quarantine."""
    store, *_ = loaded(spark, tmp_path, OK)
    planned = {r["source_line"]: r for r in store.planned(RUN).collect()}
    waiting = [r["source_line"] for r in rows_in_state(store.ledger(RUN), RUN, "QUARANTINED").collect()]
    decisions = spark.createDataFrame(
        [(RUN, 0, n, "TARGET", "issuing-review") for n in waiting],
        "run_id string, part int, source_line bigint, decision string, chosen_target string",
    )
    refused, commands = plans.record_resolutions(store, RUN, decisions)
    lacking = {n for n in waiting if not planned[n]["applicant_name"].strip() or not planned[n]["permit_category"].strip()}
    assert {r["source_line"] for r in refused.collect()} == lacking and 0 < len(lacking) < len(waiting)
    assert {r["source_line"] for r in commands.collect()} == set(waiting) - lacking
    now = states(store)
    assert all(now[n] == ("QUARANTINED" if n in lacking else "CREATE_PENDING") for n in waiting)
    assert {r["target_element"] for r in store.planned(RUN).where("action = 'CREATE'").collect()} >= {"issuing-review"}


def of(store, section):
    return {r["key"]: r["n"] for r in store.reports(RUN).where(F.col("section") == section).collect()}


def test_a_run_to_its_end_with_its_reports(spark, tmp_path):
    store = plans.RunStore(spark, str(tmp_path / "run"))
    source, frozen = freeze(spark, tmp_path)
    sent = []

    def release(commands):
        sent.extend(r["source_line"] for r in commands.collect())
        return spark.createDataFrame(
            [(0, 2, True, None), (0, 3, True, None), (0, 4, False, "gone")],
            "part int, source_line bigint, ok boolean, message string",
        ).join(commands.select("part", "source_line"), ["part", "source_line"])

    # One create is not answered, so the gate holds everything back.
    plans.run_to_end(store, source, frozen, lambda _: answers(spark, OK[:2]), lambda: snapshot(spark, tmp_path / "s", ALIVE), release)
    assert sent == [] and of(store, "gate")["PASSED"] == 0 and of(store, "gate failure") == {"pending": 1}
    assert of(store, "load") == {"skipped": 4, "quarantined": 6, "already_loaded": 0, "refused_pending": 0, "commands": 3}
    assert of(store, "answers") == {"created": 2, "already_existed": 0, "rejected": 0}
    assert of(store, "outcome") == {"MIGRATE": 3, "SKIP": 4, "QUARANTINE": 6}
    # It turns out to exist; the same run, started again, only goes through the gate.
    late = spark.createDataFrame([(0, 4)], "part int, source_line bigint")
    plans.record_responses(store, RUN, late, answers(spark, OK[2:]))
    plans.run_to_end(store, source, frozen, lambda _: 1 / 0, lambda: snapshot(spark, tmp_path / "s2", ALIVE), release)
    assert sorted(sent) == [2, 3, 4]
    gate = of(store, "gate")
    assert gate["PASSED"] == 1 and of(store, "gate failure") == {}
    assert (gate["MIGRATED"], gate["SKIPPED"], gate["QUARANTINED"], gate["TOTAL"], gate["MANIFEST"]) == (3, 4, 6, 13, 13)
    assert of(store, "release") == {"released": 2, "failed": 1}
    assert states(store)[4] == "RELEASE_FAILED"
