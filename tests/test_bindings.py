import datetime

from pyspark.sql import functions as F

from casegate.catalog import bindings as b
from casegate.operators.reconcile import permission_map

DAY = datetime.datetime(2001, 3, 4)


def tables(spark, folder):
    """Orders over seven parts; some without attempts, one with a tie and one twice."""
    keys = [*range(0, 35_000, 250), 250]
    spark.createDataFrame(
        [(k, k % 3, "F", 1.5, DAY, "2-HIGH") for k in keys] + [(None, 1, "F", 1.5, DAY, "2-HIGH")],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(0, "zero", "BUILDING"), (1, "one", "MACHINERY")], "c_custkey bigint, c_name string, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    one = lambda k, day, n, flag, part=1: (k, part, 1, n, 1.0, 1.0, 0.0, 0.0, flag, DAY + datetime.timedelta(day) if day is not None else None)
    spark.createDataFrame(
        [one(250, 2, 1, "A"), one(250, 1, 2, "N"), one(500, 1, 1, "A", 9), one(500, 1, 1, "N", 3), one(500, None, 1, "A"), one(None, 1, 1, "A")],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_landed_lines_hold_ranges_of_parts(spark, tmp_path):
    lines = b.case_lines(spark, tables(spark, tmp_path))
    by_file = lines.where("part is not null").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("part").alias("low"), F.max("part").alias("high"))
    ranges = sorted((r["low"], r["high"]) for r in by_file.collect())
    assert len(ranges) > 1
    assert all(one[1] < two[0] for one, two in zip(ranges, ranges[1:]))
    raw = {(r["part"], r["source_line"]): r["raw"] for r in lines.collect()}
    assert lines.count() == 142
    fields = lambda k: ",".join(raw[k // b.PART_ROWS, k % b.PART_ROWS + 2].split(",")[8:-6])
    assert fields(250) == "2001-03-05,FAIL,2001-03-06,PASS,,"
    # An attempt without a day leaves its columns out, as ever; ties go by the next column.
    assert fields(500) == "2001-03-05,FAIL,2001-03-05,PASS"
    assert fields(750) == ",,,,,"


def test_attempts_are_sorted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(b, "TASK_ROWS", 1)
    found = b.attempts(spark, tables(spark, tmp_path))
    assert found.rdd.getNumPartitions() == 6
    assert {r["l_orderkey"]: len(r["attempts"]) for r in found.collect()} == {250: 2, 500: 3, None: 1}


def test_permissions_are_listed_once_without_telling_pairs_apart(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (None, 1), (3, None), (4, 9)], "user_id bigint, group_id int")
    grants = spark.createDataFrame([(1, "12.0.a.1"), (2, "12.0.a.1"), (2, "12.0.b.1"), (2, None), (None, "12.0.c.1"), (1, "12.0.a.1")], "group_id int, permission string")
    targets = spark.createDataFrame([("12", "0", "a", "1", "x"), ("12", "0", "a", "1", "x"), ("12", "0", "a", "1", "y")], "application string, service string, role string, level string, candidate_group string")
    found = permission_map(members, grants, targets)
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    one, two = "12.0.a.1", "12.0.b.1"
    wanted = [(1, one, "x"), (1, one, "y"), (1, two, None), (1, None, None), (2, one, "x"), (2, one, "y"), (2, two, None), (2, None, None), (None, one, "x"), (None, one, "y")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_cases_are_written_before_they_are_sorted(spark, tmp_path):
    """A sort reads its rows twice: they must not be placed twice."""
    from casegate.catalog import placement

    plan = placement.order_by_line(spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Generate" not in plan
