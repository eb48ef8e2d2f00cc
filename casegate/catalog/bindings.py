"""The benchmark tables seen as case records.

Orders are cases, their lineitems are attempts, customers are applicants. Defects that the rules must find are planted by key. The same
binding is written as SQL in ``oracle``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.functions.text import blank_to_null, line_hash
from casegate.functions.values import cutoff_boundary
from casegate.operators.ledger import fold_ledger
from casegate.operators.load import (
    apply_create_responses,
    create_commands,
    intent_events,
    load_plan,
    response_events,
)
from casegate.plans.classify import classify
from casegate.session import TASK_ROWS, tasks_for, workspace
from casegate.sources.export import source_records, write_parts
from casegate.sources.ledger_store import LedgerStore
from casegate.sources.manifest import build_manifest_lines
from casegate.sources.tables import ledger_events

RUN_ID = "run-1"
PROCESS_ID = "permit-process"
FREEZE_DATE = "2001-09-15"
CUTOFF_MONTHS = 36
LOAD_SEQ = 10
# Records per export part: bounds the size of every text file, and is small enough
# that the test sizes have several parts.
PART_ROWS = 5_000
# Records per landed file.
FILE_ROWS = 2_000_000
# Bytes of a row group of the landed lines: the few files that a stream takes at a time
# are split among all cores.
LINES_GROUP = 16 << 20
PRIOR_KEY = 1_000_000_000_000_000
NEW_KEY = 2_000_000_000_000_000
ORPHAN_KEY = 9_000_000_000_000_000

# The export's columns around the numbered attempts.
HEADER_START = "CASE_REF,ISN,APPLICANT_USER_ID,APPLICANT_NAME,PERMIT_CATEGORY,FEE_AMOUNT,LAST_UPDATED,FEE_PAID"
HEADER_END = "RESTR_1,RESTR_2,RESTR_3,ISSUED,EXPIRED,DATE_COMPLETED"

ATTEMPT_ORDER = [
    "l_shipdate",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
]

_written: dict[tuple[str, str, str], str] = {}
_attempts: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(
    spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]
) -> str:
    """Path of a table derived from ``sf_dir``, written once per application to
    the shared workspace."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir, name) not in _written:
        folder = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{workspace(spark)}/{folder}/{name}"
        write(path)
        _written[app, sf_dir, name] = path
    return _written[app, sf_dir, name]


def boundary() -> Column:
    return cutoff_boundary(F.to_date(F.lit(FREEZE_DATE)), CUTOFF_MONTHS)


def every(key: Column, n: int, rest: int = 0) -> Column:
    return key % n == rest


def day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def attempt_result(flag: Column) -> Column:
    """Accepted lines are passes, all others failures."""
    return F.when(flag == "A", "PASS").otherwise("FAIL")


def long_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt in long form, with one sortable position per order."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        *ATTEMPT_ORDER,
        attempt_result(F.col("l_returnflag")).alias("result"),
    )


def n_attempts(spark: SparkSession, sf_dir: str) -> int:
    """The most attempts of an order: the export has as many pairs of columns."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) not in _attempts:
        counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
        _attempts[app, sf_dir] = counts.agg(F.max("count")).first()[0] or 0
    return _attempts[app, sf_dir]


def header(spark: SparkSession, sf_dir: str) -> str:
    """The export's header line, as wide as its data."""
    pairs = [f"VT_{n}_DATE,VT_{n}_RESULT" for n in range(1, n_attempts(spark, sf_dir) + 1)]
    return ",".join([HEADER_START, *pairs, HEADER_END])


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts of each order as one ordered array. A task sorts a bounded number of
    them, however few partitions the session asks for, and none twice."""
    one = F.struct(*ATTEMPT_ORDER)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *ATTEMPT_ORDER)
    tasks = tasks_for(spark, rows.count(), TASK_ROWS)
    # sort_array runs as generated code; array_sort would call a comparator per pair.
    return rows.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("attempts"))


def attempt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's attempts as the text of their fields, slots without one included:
    what is joined to the orders is as narrow as what is written."""
    k = F.col("l_orderkey")

    def pair(one: Column, n: Column) -> Column:
        date = F.when((n == 0) & every(k, 113), "").otherwise(day(one["l_shipdate"]))
        result = F.when(every(k, 107), "MAYBE").otherwise(attempt_result(one["l_returnflag"]))
        return F.concat(date, F.lit(","), result)

    free = F.array_repeat(F.lit(","), F.lit(n_attempts(spark, sf_dir)) - F.size("attempts"))
    pairs = F.concat(F.transform("attempts", pair), free)
    return attempts(spark, sf_dir).select("l_orderkey", F.array_join(pairs, ",").alias("attempts"))


def wide_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as wide text fields, one row per order."""
    k = F.col("o_orderkey")
    blank = F.lit("")
    ordered = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # Slim rows are joined first; the attempts come last, when the rows are complete.
    applicants = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = applicants.join(attempt_fields(spark, sf_dir), k == F.col("l_orderkey"), "left")
    none = F.array_join(F.array_repeat(F.lit(","), n_attempts(spark, sf_dir)), ",")
    fields = {
        "case_ref": F.when(every(k, 97), "")
        .when(every(k, 211, 1), F.concat(F.lit("LP-"), (k - 1).cast("string")))
        .otherwise(F.concat(F.lit("LP-"), k.cast("string"))),
        "isn": (k + 8891).cast("string"),
        "applicant_user_id": F.when(every(k, 103), "").otherwise(
            F.concat(F.lit("U."), F.coalesce(F.col("c_custkey").cast("string"), blank))
        ),
        "applicant_name": F.when(every(F.col("c_custkey"), 50), "").otherwise(
            F.coalesce("c_name", blank)
        ),
        "permit_category": F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(
            F.coalesce(F.substring("c_mktsegment", 1, 1), blank)
        ),
        "fee_amount": F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"),
        "last_updated": F.when(every(k, 89), "")
        .when(every(k, 83), "1998-13-01")
        .when(every(k, 79), "1998-1-5")
        .otherwise(day(ordered)),
        "fee_paid": F.when(every(k, 101), "SORT OF")
        .when(F.col("o_orderpriority") == "1-URGENT", "TRUE")
        .when(F.col("o_orderpriority") == "2-HIGH", "Y")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "FALSE")
        .when(F.col("o_orderpriority") == "5-LOW", "N")
        .otherwise(""),
        "attempts": F.when(F.col("l_orderkey").isNull(), none).otherwise(F.col("attempts")),
        "restr_1": F.when(every(k, 4), "B").otherwise(""),
        "restr_2": blank,
        "restr_3": F.when(every(k, 6), "G").otherwise(""),
        "issued": F.when(
            status == "F", F.when(every(k, 109), "not-a-date").otherwise(day(ordered))
        ).otherwise(""),
        "expired": F.when(
            ((status == "F") & every(k, 3)) | ((status == "O") & every(k, 71)),
            day(F.date_add(ordered, 1000)),
        ).otherwise(""),
        "date_completed": F.when(
            (status == "F") & every(k, 5), day(F.date_add(ordered, 7))
        ).otherwise(""),
    }
    return joined.select(
        k.alias("k"),
        F.floor(k / PART_ROWS).cast("int").alias("part"),
        (k % PART_ROWS + 2).alias("source_line"),
        *[column.alias(name) for name, column in fields.items()],
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as raw export lines ``(part, source_line, raw)``."""
    wide = wide_cases(spark, sf_dir)
    names = [c for c in wide.columns if c not in ("k", "part", "source_line")]
    return wide.select("part", "source_line", F.concat_ws(",", *names).alias("raw"))


def lines_path(spark: SparkSession, sf_dir: str) -> str:
    """The numbered raw lines as landed in a table, in files that keep every core
    busy and none too large. Each file holds a range of the parts, so what reads some
    of the files needs some of the parts."""

    def write(path: str) -> None:
        part = F.floor(F.col("o_orderkey") / PART_ROWS).cast("int")
        orders = table(spark, sf_dir, "orders").select(part.alias("part"))
        records = orders.count()
        files = max(spark.sparkContext.defaultParallelism, -(-records // FILE_ROWS))
        shares = [i / files for i in range(1, files)]
        cuts = orders.agg(F.percentile_approx("part", shares or [0.5])).first()[0] or []  # one number per file
        above = F.filter(F.lit([int(c) for c in cuts[: len(shares)]]).cast("array<int>"), lambda cut: cut < F.col("part"))
        # Records without a key have no part, and lie together anywhere.
        landed = raw_lines(spark, sf_dir).repartitionById(files, F.coalesce(F.size(above), F.lit(0)))
        landed.write.option("compression", "zstd").option("parquet.block.size", LINES_GROUP).parquet(path)

    return written(spark, sf_dir, "lines", write)


def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(lines_path(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records, parsed from the landed lines."""
    return source_records(case_lines(spark, sf_dir), header(spark, sf_dir))


def n_cases(spark: SparkSession, sf_dir: str) -> int:
    """The number of cases, from the footers of the table's files."""
    return table(spark, sf_dir, "orders").count()


def classified(
    spark: SparkSession, sf_dir: str, rules: DataFrame | None = None
) -> DataFrame:
    return classify(cases(spark, sf_dir), boundary(), rules)


def order_key() -> Column:
    """Back from a record's identity to the order key the planted defects use."""
    return F.col("part").cast("bigint") * PART_ROWS + F.col("source_line") - 2


# ---- text files -----------------------------------------------------------


def export_path(spark: SparkSession, sf_dir: str) -> str:
    """The cases as a text export: one file per part, header first."""

    def write(path: str) -> None:
        lines = case_lines(spark, sf_dir)
        orders = table(spark, sf_dir, "orders")
        parts = orders.select(F.floor(F.col("o_orderkey") / PART_ROWS).cast("int").alias("part"))
        first = parts.distinct().select(
            "part", F.lit(1).cast("bigint").alias("source_line"), F.lit(header(spark, sf_dir)).alias("raw")
        )
        write_parts(lines.unionByName(first), path, rows=n_cases(spark, sf_dir))

    return written(spark, sf_dir, "export", write)


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / PART_ROWS).cast("int").alias("part")
    )
    return parts.distinct().withColumn("header_hash", line_hash(F.lit(header(spark, sf_dir))))


def manifest_path(spark: SparkSession, sf_dir: str) -> str:
    """A manifest for the export. Some rows are left out, some hashes are wrong,
    and some rows point at lines the export does not have."""

    def write(path: str) -> None:
        k = order_key()
        frozen = cases(spark, sf_dir).where(~every(k, 127))
        changed = F.when(every(k, 131), line_hash(F.col("case_ref"))).otherwise(F.col("source_hash"))
        ghosts = frozen.where(every(k, 137)).withColumn(
            "source_line", F.col("source_line") + 500_000_000
        )
        rows = frozen.withColumn("source_hash", changed).unionByName(ghosts)
        lines = build_manifest_lines(
            rows, header_rows(spark, sf_dir), RUN_ID, FREEZE_DATE, CUTOFF_MONTHS
        )
        write_parts(lines, path, "at", rows=n_cases(spark, sf_dir))

    return written(spark, sf_dir, "manifest", write)


def expectations_path(spark: SparkSession, sf_dir: str) -> str:
    """Expectations that disagree on some records, miss some and invent some."""

    def write(path: str) -> None:
        k = order_key()
        known = classified(spark, sf_dir).where(~every(k, 41)).withColumn(
            "outcome", F.when(every(k, 37), "SKIP").otherwise(F.col("outcome"))
        )
        invented = known.where(every(k, 43)).withColumn(
            "source_line", F.col("source_line") + 500_000_000
        )
        rows = known.unionByName(invented)
        lines = rows.select(
            "part",
            "source_line",
            F.concat_ws(
                ",",
                F.col("source_line").cast("string"),
                "case_ref",
                "outcome",
                F.coalesce("target_element", F.lit("")),
                F.coalesce("reason_code", F.lit("")),
                F.lit("stated by hand, with commas, in free text"),
            ).alias("raw"),
        )
        write_parts(lines, path, rows=n_cases(spark, sf_dir))

    return written(spark, sf_dir, "expectations", write)


# ---- ledger and snapshots --------------------------------------------------


def prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier, interrupted load left: some cases created, some never
    answered, some that failed at release."""
    k = order_key()
    kind = F.when(every(k, 7), "CREATED").when(every(k, 11), "CREATE_PENDING").when(
        every(k, 13), "RELEASE_FAILED"
    )
    rows = cases(spark, sf_dir).withColumn("prior", kind).where("prior is not null")

    def event(event_kind: str, state: str, seq: int, detail: str | None, with_key: bool) -> Column:
        return F.struct(
            F.lit(event_kind).alias("kind"),
            F.lit(state).alias("state"),
            F.lit(seq).alias("seq"),
            F.lit(detail).cast("string").alias("detail"),
            (k + PRIOR_KEY if with_key else F.lit(None)).cast("bigint").alias("instance_key"),
        )

    begun = [
        event("CLASSIFY", "CLASSIFIED", 1, "EARLIER", False),
        event("TRANSITION", "CREATE_PENDING", 2, None, False),
    ]
    created = [event("CONFIRM", "CREATED", 3, None, True)]
    failed = [
        event("TRANSITION", "RELEASE_PENDING", 4, None, False),
        event("TRANSITION", "RELEASE_FAILED", 5, "TIMEOUT", False),
    ]
    steps = (
        F.when(F.col("prior") == "CREATE_PENDING", F.array(*begun))
        .when(F.col("prior") == "CREATED", F.array(*begun, *created))
        .otherwise(F.array(*begun, *created, *failed))
    )
    spread = rows.select("*", F.inline(steps)).select(
        F.lit(RUN_ID).alias("run_id"),
        "part",
        "source_line",
        "source_hash",
        blank_to_null(F.col("case_ref")).alias("case_ref"),
        F.lit("vision-assessment").alias("target_element"),
        "kind",
        "state",
        "seq",
        "detail",
        "instance_key",
    )
    return ledger_events(spread)


def prior_path(spark: SparkSession, sf_dir: str) -> str:
    """The earlier load's events as a table, for what reads them again and again."""
    return written(spark, sf_dir, "prior", lambda path: prior_events(spark, sf_dir).write.parquet(path))


def prior_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_ledger(prior_events(spark, sf_dir))


def create_answers(commands: DataFrame) -> DataFrame:
    """Answers to create commands: refused duplicates, rejections, lost answers."""
    k = order_key()
    code = F.when(every(k, 5), 409).when(every(k, 19), 500).otherwise(200)
    return commands.where(every(k, 5) | every(k, 19) | ~every(k, 23)).select(
        "part",
        "source_line",
        code.alias("code"),
        F.when(code == 500, "REJECTED").alias("message"),
        F.when(code == 200, k + NEW_KEY).alias("instance_key"),
    )


# What the load, its intents and its commands read of a classified record.
PLANNED = [
    "part", "source_line", "source_hash", "case_ref", "applicant_user_id", "outcome", "target_element",
    "reason_code", "rule_ids", "detail", "target_variables",
]


def plan_of_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with what the load does about it. A task of the join sorts a bounded
    number of them."""
    tasks = tasks_for(spark, n_cases(spark, sf_dir), TASK_ROWS)
    cases_ = classified(spark, sf_dir).select(*PLANNED).repartition(tasks, "part", "source_line")
    return load_plan(cases_, prior_ledger(spark, sf_dir))


def plan_path(spark: SparkSession, sf_dir: str) -> str:
    """The load plan, written before its intents so that both steps see one plan."""
    return written(
        spark, sf_dir, "plan", lambda path: plan_of_load(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    )


def ledger_path(spark: SparkSession, sf_dir: str) -> str:
    """The event log of the run after one load: earlier events, intents, answers."""

    def write(path: str) -> None:
        plan = spark.read.parquet(plan_path(spark, sf_dir))
        commands = create_commands(plan, RUN_ID)
        applied = apply_create_responses(commands, create_answers(commands))
        store = LedgerStore(spark, path, merge_every=2)
        store.append(prior_events(spark, sf_dir))
        store.append(intent_events(plan, RUN_ID, LOAD_SEQ))
        store.append(response_events(applied, RUN_ID, LOAD_SEQ + 2))
        store.compact()

    return written(spark, sf_dir, "ledger", write)


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's snapshot, which two merges brought up to the last batch."""
    return LedgerStore(spark, ledger_path(spark, sf_dir)).current(RUN_ID)


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's ledger, and a second run that took over a third of the cases."""
    ledger = run_ledger(spark, sf_dir)
    second = ledger.where(every(order_key(), 3)).withColumn("run_id", F.lit("run-2"))
    return ledger.unionByName(second)


def snapshot_path(spark: SparkSession, sf_dir: str) -> str:
    """Exported instances: one per known key, some cancelled, some at a wrong
    element, and copies of some that the ledger never heard of."""

    def write(path: str) -> None:
        k = order_key()
        rows = run_ledger(spark, sf_dir).where("instance_key is not null")
        element = F.when(every(k, 31), "apply-for-permit").otherwise(F.col("target_element"))
        known = rows.select(
            "instance_key",
            F.lit(PROCESS_ID).alias("process_id"),
            F.col("case_ref").alias("business_id"),
            element.alias("element_id"),
            F.when(every(k, 29), "CANCELED").otherwise("ACTIVE").alias("state"),
        )
        copies = rows.where(every(k, 17)).select(
            (k + ORPHAN_KEY).alias("instance_key"),
            F.lit(PROCESS_ID).alias("process_id"),
            F.col("case_ref").alias("business_id"),
            F.col("target_element").alias("element_id"),
            F.lit("ACTIVE").alias("state"),
        )
        known.unionByName(copies).write.parquet(path)

    return written(spark, sf_dir, "instances", write)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a ledger log keyed by user, in time order."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "CREATE_PENDING")
        .when(kind == "click", "CREATED")
        .when(kind == "view", "RELEASE_PENDING")
        .when(kind == "purchase", "RELEASED")
        .otherwise("RELEASE_FAILED")
    )
    event_kind = F.when(kind == "signup", "CLASSIFY").when(kind == "click", "CONFIRM").otherwise(
        "TRANSITION"
    )
    signup = kind == "signup"
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.lit(0).alias("part"),
        (F.col("user_id") + 2).alias("source_line"),
        event_kind.alias("kind"),
        F.when(signup, F.concat(F.lit("sha256:"), F.sha2("props", 256))).alias("source_hash"),
        F.when(signup, F.concat(F.lit("LP-"), F.col("user_id").cast("string"))).alias("case_ref"),
        state.alias("state"),
        F.when(signup, F.concat(F.lit("element-"), (F.col("event_id") % 3).cast("string"))).alias(
            "target_element"
        ),
        F.when(kind.isin("error", "signup") & every(F.col("event_id"), 2), F.col("props")).alias(
            "detail"
        ),
        F.when(kind == "click", F.col("event_id") + PRIOR_KEY).alias("instance_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
    )
    return ledger_events(rows)
