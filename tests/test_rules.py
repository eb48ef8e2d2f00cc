import pytest
from pyspark.sql import functions as F

from casegate.operators import decide, normalise, validate
from casegate.plans.classify import classify, rule_change_diff
from casegate.sources import rules
from tests.samples import record, records


def boundary():
    return F.to_date(F.lit("2026-03-15"))


@pytest.mark.parametrize(
    "changes, detail",
    [
        ({}, None),
        ({"case_ref": ""}, "MISSING_KEY"),
        ({"case_ref": "\u2003"}, "MISSING_KEY"),
        ({"case_ref": "", "applicant_user_id": ""}, "MISSING_KEY"),
        ({"applicant_user_id": ""}, "MISSING_USER"),
        ({"last_updated": ""}, "LAST_UPDATED_MISSING"),
        ({"last_updated": "2026-02-30"}, "LAST_UPDATED_UNPARSEABLE:2026-02-30"),
        ({"fee_paid": "SORT OF"}, "FEE_PAID_UNRECOGNISED:SORT OF"),
        ({"issued": "x", "expired": "y"}, "DATE_UNPARSEABLE:x"),
        ({"expired": "y", "issued": "2026-01-01"}, "DATE_UNPARSEABLE:y"),
        ({"attempts": [(1, "2026-01-01", "pass"), (2, "", "")]}, "ATTEMPT_RESULT:2:"),
        ({"attempts": [(1, "bad", "PASS"), (2, "bad", "WHAT")]}, "ATTEMPT_DATE:1:bad"),
        ({"attempts": [(3, "", "FAIL")]}, "ATTEMPT_DATE:3:"),
        ({"expired": "2026-01-01"}, "EXPIRED_WITHOUT_ISSUED"),
        ({"date_completed": "2026-01-01"}, "COMPLETED_WITHOUT_ISSUED"),
    ],
)
def test_first_failing_rule_is_reported(spark, changes, detail):
    assert validate.prevalidate(records(spark, [record(**changes)])).first()["detail"] == detail


@pytest.mark.parametrize(
    "attempts, latest, first, any_pass",
    [
        ([], "NONE", "NONE", "NONE"),
        ([(1, "2026-05-02", "FAIL"), (2, "2026-06-10", "PASS")], "PASS", "FAIL", "PASS"),
        ([(1, "2026-06-10", "PASS"), (2, "2026-05-02", "fail")], "PASS", "FAIL", "PASS"),
        ([(1, "2026-05-02", "PASS"), (2, "2026-05-02", "FAIL")], "FAIL", "PASS", "PASS"),
        ([(1, "2026-05-02", "FAIL")], "FAIL", "FAIL", "FAIL"),
    ],
)
def test_collapse_policies(spark, attempts, latest, first, any_pass):
    typed = validate.typed(records(spark, [record(attempts=attempts)]))
    row = typed.select(
        *[f(F.col("_attempts")).alias(name) for name, f in normalise.COLLAPSE_POLICIES.items()]
    ).first()
    assert tuple(row) == (latest, first, any_pass)


def test_cells_are_numbered_both_ways(spark):
    cells = decide.domain(spark)
    again = cells.withColumn("again", normalise.cell_of(F.struct(*rules.INPUTS)))
    assert again.where("again <> cell").count() == 0
    assert cells.select(*rules.INPUTS).distinct().count() == 96


def test_baseline_covers_92_of_96_and_never_twice(spark):
    observed = classify(records(spark, [record()]), boundary())
    rows = decide.domain_coverage(spark, rules.baseline_rules(spark), observed).collect()
    assert [sum(r["n_hits"] == n for r in rows) for n in (0, 1)] == [4, 92]
    gaps = {(r["fee_paid"], r["vision_outcome"], r["has_expired"]) for r in rows if r["n_hits"] == 0}
    assert gaps == {(True, v, e) for v in ("NONE", "FAIL") for e in (True, False)}
    reachable = [r for r in rows if r["reachable"]]
    assert (len(reachable), sum(r["n_hits"] > 0 for r in reachable)) == (60, 58)
    per_rule = decide.rule_usage(rules.baseline_rules(spark), observed).collect()
    assert {r["rule_id"]: r["n_cells"] for r in per_rule} == {
        "R1": 48, "R2": 12, "R3": 12, "R4": 12, "R5": 2, "R6": 2, "R7": 2, "R8": 2,
    }


def test_overlapping_rules_are_redundant_or_ambiguous(spark):
    rows = [
        record(2, issued="2026-04-01", fee_paid="TRUE"),
        record(3, issued="2026-04-01", expired="2026-05-01", date_completed="2026-05-01"),
        record(4, fee_paid="TRUE"),
        record(5, fee_paid="TRUE", attempts=[(1, "2026-05-01", "FAIL")]),
    ]
    placed = classify(records(spark, rows), boundary(), rules.overlap_rules(spark))
    found = {
        r["source_line"]: (r["outcome"], r["reason_code"], r["redundant"], r["rule_ids"])
        for r in placed.collect()
    }
    assert found[2] == ("SKIP", "LIVE_PERMIT", True, ["R2", "X1"])
    assert found[3] == ("QUARANTINE", "AMBIGUOUS", False, ["R1", "X2"])
    assert found[4] == ("QUARANTINE", "CITIZEN_TARGET", False, ["X3"])
    assert found[5] == ("QUARANTINE", "UNMATCHED", False, [])


def test_contract_failure_clears_target_and_redundancy(spark):
    paid = dict(fee_paid="TRUE", attempts=[(1, "2026-05-01", "PASS")])
    twice = [*rules.BASELINE_RULES, ("Y1", *rules.BASELINE_RULES[6][1:])]
    frame = records(spark, [record(2, **paid), record(3, permit_category="\u2003", **paid)])
    rows = classify(frame, boundary(), rules.rules_table(spark, twice)).orderBy("source_line").collect()
    assert (rows[0]["outcome"], rows[0]["redundant"]) == ("MIGRATE", True)
    assert rows[0]["target_variables"] == {"applicantName": "One Person", "permitCategory": "B"}
    assert (rows[1]["reason_code"], rows[1]["target_element"], rows[1]["redundant"]) == (
        "CONTRACT_UNSATISFIED", None, False,
    )
    assert rows[1]["rule_ids"] == ["R7", "Y1"] and rows[1]["target_variables"] == {}


def test_a_contract_may_name_a_variable_nobody_offers(spark):
    contract = decide.contract_table(spark, {"vision-assessment": ["applicantName", "shoeSize"]})
    row = classify(records(spark, [record()]), boundary(), contract=contract).first()
    assert row["reason_code"] == "CONTRACT_UNSATISFIED"


def test_a_rule_without_outcome_stops_the_run_only_when_it_decides(spark):
    broken = [(*r[:7], None, *r[8:]) if r[0] == "R5" else r for r in rules.BASELINE_RULES]
    table = rules.rules_table(spark, broken)
    assert decide.null_outcome_rules(table).count() == 1
    assert classify(records(spark, [record(issued="2026-04-01")]), boundary(), table).count() == 1
    with pytest.raises(Exception, match="no known outcome"):
        classify(records(spark, [record()]), boundary(), table).collect()


def test_rules_survive_the_xml_form(spark, tmp_path):
    path = tmp_path / "rules.xml"
    path.write_text(rules.rules_to_xml(rules.OVERLAP_RULES))
    read = rules.scan_rules_xml(spark, str(path)).drop("position").collect()
    wanted = rules.overlap_rules(spark).drop("position").collect()
    assert sorted(map(str, read)) == sorted(map(str, wanted))
    version = rules.rule_version(rules.scan_rules_xml(spark, str(path))).first()
    assert version == rules.rule_version(rules.overlap_rules(spark)).first()
    assert version != rules.rule_version(rules.baseline_rules(spark)).first()


def plain(frame):
    return sorted(str(r) for r in frame.drop("position").collect())


def test_columns_are_known_by_id_and_not_by_place(spark, tmp_path):
    path = tmp_path / "rules.xml"
    path.write_text(rules.rules_to_xml(rules.OVERLAP_RULES, rules.INPUTS[::-1], ["reason_code", "rule_id", "outcome", "target_element"]))
    assert plain(rules.scan_rules_xml(spark, str(path))) == plain(rules.overlap_rules(spark))
    whole = rules.rules_to_xml(rules.BASELINE_RULES)
    bare = tmp_path / "bare.xml"  # no rule-id column: the rule's own id
    bare.write_text(rules.rules_to_xml(rules.BASELINE_RULES, outputs=rules.OUTPUTS))
    assert plain(rules.scan_rules_xml(spark, str(bare))) == plain(rules.baseline_rules(spark))
    plainest = tmp_path / "plain.xml"  # no columns declared: the usual order
    plainest.write_text("\n".join(l for l in whole.splitlines() if not l.startswith(("<input ", "<output "))))
    assert plain(rules.scan_rules_xml(spark, str(plainest))) == plain(rules.baseline_rules(spark))
    for name, change in [("unknown", ("in-fee-paid", "in-fee")), ("twice", ("in-fee-paid", "in-has-issued"))]:
        broken = tmp_path / f"{name}.xml"
        broken.write_text(whole.replace(*change))
        with pytest.raises(ValueError, match="lacking"):
            rules.scan_rules_xml(spark, str(broken))


def test_csv_and_parquet_tables_give_the_same_rules(spark, tmp_path):
    names = ["rule_id", *rules.INPUTS, *rules.OUTPUTS]
    rows = ["owner," + ",".join(names[::-1])]
    for rule in rules.OVERLAP_RULES:
        rows.append("me," + ",".join("-" if v is None else str(v) for v in rule[::-1]))
    csv = tmp_path / "rules.csv"
    csv.write_text("\n".join(rows) + "\n")
    read = rules.scan_rules_table(spark, str(csv), "csv")
    assert plain(read) == plain(rules.overlap_rules(spark))
    order = [r["rule_id"] for r in read.orderBy("position").collect()]
    assert order == [r[0] for r in rules.OVERLAP_RULES]
    rules.overlap_rules(spark).write.parquet(str(tmp_path / "rules"))
    assert sorted(map(str, rules.scan_rules_table(spark, str(tmp_path / "rules")).collect())) == sorted(map(str, rules.overlap_rules(spark).collect()))
    csv.write_text("\n".join(rows).replace("PASS", "PERHAPS") + "\n")
    with pytest.raises(Exception, match="unsupported cell"):
        rules.scan_rules_table(spark, str(csv), "csv").collect()
    csv.write_text(rows[0].replace("fee_paid", "fee") + "\n")
    with pytest.raises(ValueError, match="lacks"):
        rules.scan_rules_table(spark, str(csv), "csv")


def test_rule_change_lists_only_moved_cases(spark):
    frame = records(spark, [record(2), record(3, fee_paid="TRUE")])
    moved = rule_change_diff(
        frame, boundary(), rules.baseline_rules(spark), rules.overlap_rules(spark)
    ).collect()
    assert [(r["source_line"], r["before_reason_code"], r["after_reason_code"]) for r in moved] == [
        (3, "UNMATCHED", "CITIZEN_TARGET")
    ]


def test_classification_needs_no_shuffle_of_records(spark):
    frame = records(spark, [record()])
    plan = classify(frame, boundary())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan
    above = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in above


def test_duplicate_keys_leave_blank_keys_alone(spark):
    frame = records(spark, [record(2, case_ref="D"), record(3, case_ref="D"), record(4, case_ref=""), record(5, case_ref="")])
    assert [r["source_line"] for r in validate.records_with_duplicate_key(frame).orderBy("source_line").collect()] == [2, 3]
