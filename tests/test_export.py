from pyspark.sql import functions as F

from casegate.sources import export


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode())
    return str(path)


def test_numbers_count_blank_lines_and_every_line_end(spark, tmp_path):
    path = write(tmp_path, "a.txt", "CASE_REF,ISN\r\nA,1\n\nB,2\rC,3\n")
    rows = export.scan_export(spark, path).select("source_line", "case_ref", "isn").collect()
    assert sorted(map(tuple, rows)) == [(2, "A", "1"), (4, "B", "2"), (5, "C", "3")]


def test_numbering_over_many_splits_of_one_file(spark, tmp_path):
    body = "".join(f"line-{i}{'x' * (i % 37)}\n" for i in range(1, 20_001))
    path = write(tmp_path, "big.txt", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = export.read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        numbered = export.number_lines(lines)
        wanted = F.regexp_extract("raw", r"line-(\d+)x*$", 1).cast("bigint")
        assert numbered.where(F.col("source_line") != wanted).count() == 0
        assert numbered.select("source_line").distinct().count() == 20_000
        assert export.read_header(spark, path).startswith("line-1")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def landed(spark, splits, files, rows):
    """Lines as ``read_lines`` gives them, of files with many splits."""
    at = F.spark_partition_id()
    return spark.range(0, rows, 1, splits).select(
        F.lit(0).alias("part"),
        F.concat(F.lit("f"), at % files).alias("file"),
        (at * 128).cast("bigint").alias("block"),
        F.monotonically_increasing_id().alias("row_mark"),
        F.concat(F.lit("line-"), "id").alias("raw"),
    )


def test_thousands_of_splits(spark):
    """Against the order of file and split in plain Python."""
    numbered = export.number_lines(landed(spark, 2400, 3, 7200)).collect()
    where = sorted((i // 3 % 3, i // 3, i) for i in range(7200))
    wanted, last = {}, {}
    for file, _, i in where:
        last[file] = last.get(file, 0) + 1
        wanted[f"line-{i}"] = (f"f{file}", last[file])
    assert {r["raw"]: (r["file"], r["source_line"]) for r in numbered} == wanted


def test_many_small_files_in_one_task(spark, tmp_path):
    for i in range(40):
        write(tmp_path, f"part={i}/x.txt", "".join(f"line-{n}\n" for n in range(1, 2 + i % 5)))
    wanted = F.regexp_extract("raw", r"line-(\d+)$", 1).cast("bigint")
    numbered = export.number_lines(export.read_lines(spark, str(tmp_path)))
    assert numbered.where(F.col("source_line") == wanted).count() == numbered.count() == sum(1 + i % 5 for i in range(40))


def test_without_a_broadcast_lines_meet_offsets_by_task(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "a.txt", "".join(f"line-{i}\n" for i in range(1, 2_001)))
    monkeypatch.setattr(export, "broadcast_if_small", lambda df: df.hint("merge"))
    numbered = export.number_lines(export.read_lines(spark, path))
    wanted = F.regexp_extract("raw", r"line-(\d+)$", 1).cast("bigint")
    assert numbered.where(F.col("source_line") == wanted).count() == 2_000


def test_numbers_outlast_other_splits_and_rewritten_files(spark, tmp_path):
    path = write(tmp_path, "one.txt", "".join(f"line-{i}\n" for i in range(1, 20_002)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    numbered = export.number_lines(export.read_lines(spark, path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    write(tmp_path, "one.txt", "".join(f"other-{i}\n" for i in range(1, 9_001)))
    try:
        wanted = F.regexp_extract("raw", r"line-(\d+)$", 1).cast("bigint")
        assert numbered.where(F.col("source_line") == wanted).count() == 20_001
        again = export.number_lines(export.read_lines(spark, path))
        wanted = F.regexp_extract("raw", r"other-(\d+)$", 1).cast("bigint")
        assert again.where(F.col("source_line") == wanted).count() == again.count() == 9_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbering_does_not_shuffle_the_lines(spark, tmp_path):
    path = write(tmp_path, "a.txt", "H\nA\nB\n")
    plan = export.number_lines(export.read_lines(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_are_numbered_on_their_own(spark, tmp_path):
    for part in (0, 3):
        write(tmp_path, f"part={part}/x.txt", f"CASE_REF\nP{part}-a\nP{part}-b\n")
    rows = export.scan_export(spark, str(tmp_path)).select("part", "source_line", "case_ref").collect()
    assert sorted(map(tuple, rows)) == [(0, 2, "P0-a"), (0, 3, "P0-b"), (3, 2, "P3-a"), (3, 3, "P3-b")]


def test_every_part_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path, "part=0/x.txt", "CASE_REF,ISN\nA,1\n")
    write(tmp_path, "part=1/x.txt", "ISN,CASE_REF\n2,B\n3,C\n")
    rows = export.scan_export(spark, str(tmp_path)).select("part", "source_line", "case_ref", "isn").collect()
    assert sorted(map(tuple, rows)) == [(0, 2, "A", "1"), (1, 2, "B", "2"), (1, 3, "C", "3")]


def test_occurrences_are_discovered_not_assumed(spark, tmp_path):
    path = write(
        tmp_path, "a.txt",
        "CASE_REF,VT_4_DATE,VT_4_RESULT,VT_01_DATE,RESTR_2,RESTR_1,VT_X_DATE\n"
        "A,2026-01-01,PASS,2025-01-01,r2,r1,no\n"
        "B,,,,,,\n"
        "C,,FAIL,,,r1,\n",
    )
    rows = {r["case_ref"]: r for r in export.scan_export(spark, path).collect()}
    assert [tuple(a) for a in rows["A"]["attempts"]] == [(1, "2025-01-01", ""), (4, "2026-01-01", "PASS")]
    assert rows["A"]["restrictions"] == ["r1", "r2"]
    assert rows["B"]["attempts"] == [] and rows["B"]["restrictions"] == []
    assert [tuple(a) for a in rows["C"]["attempts"]] == [(4, "", "FAIL")]


def test_renaming_a_column_changes_the_header_hash(spark, tmp_path):
    hashes = []
    for name, header in [("a.txt", "CASE_REF,ISN"), ("b.txt", "CASE_REF,ISM"), ("c.txt", "CASE_REF,ISN\r")]:
        path = write(tmp_path, name, header + "\nA,1\n")
        numbered = export.number_lines(export.read_lines(spark, path))
        hashes.append(export.header_hashes(numbered).first()["header_hash"])
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_exploding_attempts_splits_a_line_once(spark):
    """However many columns there are, and whatever Spark adds to drop empty arrays."""
    names = ["CASE_REF", *[f"VT_{n}_{kind}" for n in (2, 1, *range(3, 40)) for kind in ("RESULT", "DATE")], "VT_50_DATE"]
    lines = [(0, 1, ",".join(names)), (0, 2, "A,PASS,2001-01-02, ,2001-01-01,,,FAIL"), (0, 3, "B"), (0, 4, "C" + "," * 79 + "2001-05-05")]
    records = export.source_records(spark.createDataFrame(lines, "part int, source_line bigint, raw string"), lines[0][2])
    found = records.select("case_ref", F.inline("attempts"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted(map(tuple, found.collect())) == [
        ("A", 1, "2001-01-01", ""), ("A", 2, "2001-01-02", "PASS"), ("A", 4, "", "FAIL"), ("C", 50, "2001-05-05", ""),
    ]


def test_readings_but_those_of_attempts_run_as_generated_code(spark):
    from casegate.operators.validate import prevalidate

    lines = spark.range(2, 4).select(F.lit(0).alias("part"), F.col("id").alias("source_line"), F.lit("A,2001-02-03,,").alias("raw"))
    records = export.source_records(lines, "CASE_REF,LAST_UPDATED,VT_1_DATE,VT_1_RESULT")
    plan = prevalidate(records)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate inline" in line]
    # Fields of the line, plain readings and the first failure; attempts and their rule loop.
    assert sum("*(" in line.split("Generate")[0] for line in steps) == 3
    assert len(steps) == 5
