from pyspark.sql import functions as F

from casegate.operators import decide, reconcile, report
from casegate.sources import rules
from tests.samples import record, records


def profile(spark, rows):
    sketches = report.part_sketches(records(spark, rows), F.lit("2026-09-15").cast("date"))
    return report.key_and_age_profile(sketches).first()


def test_sketches_of_parts_merge_to_the_profile_of_the_whole(spark):
    rows = [
        record(i, part=i % 3, case_ref=f"T-{i % 900}", last_updated=f"2026-{1 + i % 8:02d}-{1 + i % 28:02d}") for i in range(2, 1802)
    ]
    rows += [record(1, case_ref=" ", last_updated="2026-02-30"), record(0, case_ref="", last_updated="")]
    found = profile(spark, rows)
    assert (found["n_records"], found["n_keyed"], found["n_aged"]) == (1802, 1800, 1800)
    ages = sorted(r["age"] for r in records(spark, rows[:1800]).selectExpr("datediff(date'2026-09-15', date(last_updated)) AS age").collect())
    assert (found["min_age"], found["max_age"]) == (ages[0], ages[-1])
    assert abs(found["n_keys"] - 900) <= 27 and abs(found["key_uniqueness"] - 0.5) <= 0.02
    rank = lambda v: (sum(a < v for a in ages) / 1800 - 0.02, sum(a <= v for a in ages) / 1800 + 0.02)
    for name, q in (("median_age", 0.5), ("p90_age", 0.9)):
        low, high = rank(found[name])
        assert low <= q <= high


def test_a_profile_without_keys_dates_or_records_is_empty(spark):
    found = profile(spark, [record(2, case_ref="", last_updated="soon"), record(3, part=1, case_ref=" ", last_updated="")])
    assert (found["n_records"], found["n_keyed"], found["n_aged"]) == (2, 0, 0)
    assert found["key_uniqueness"] is None and found["median_age"] is None and found["min_age"] is None
    nothing = profile(spark, [])
    assert nothing["n_records"] == 0 and nothing["median_age"] is None


def test_every_rule_target_is_held_against_the_model(spark):
    table = rules.overlap_rules(spark)
    elements = spark.createDataFrame([("vision-assessment",), ("issuing-review",), ("elsewhere",)], "target_element string")
    cells = decide.rule_cells(table)
    before = {r["target_element"]: (r["in_model"], r["n_records"]) for r in reconcile.rule_targets(table, cells, elements).collect()}
    assert before == {"vision-assessment": (True, 0), "issuing-review": (True, 0), "cashier-fee-review": (False, 0), "apply-for-permit": (False, 0)}
    hit = cells.where("rule_id = 'X3'").select("cell").first()["cell"]
    seen = spark.createDataFrame([(hit, 5)], "cell int, n bigint")
    after = {r["target_element"]: r["n_records"] for r in reconcile.rule_targets(table, cells, elements, seen).collect()}
    assert after["apply-for-permit"] == 5 and after["cashier-fee-review"] == 0
