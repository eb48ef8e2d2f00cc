"""The append-only state log and its folded, current picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casegate.operators.report import closed_list
from casegate.session import broadcast_if_small, materialised

# States, the reconciliation bucket of each, and the states in
# which a case holds a live instance.
STATE_BUCKETS = {
    "EXTRACTED": "PENDING",
    "CLASSIFIED": "PENDING",
    "CREATE_PENDING": "PENDING",
    "PENDING_RESOLVED_EXISTS": "PENDING",
    "PENDING_RESOLVED_ABSENT": "PENDING",
    "RELEASE_PENDING": "PENDING",
    "SKIPPED": "SKIPPED",
    "QUARANTINED": "QUARANTINED",
    "CREATED": "MIGRATED",
    "RELEASED": "MIGRATED",
    "CREATE_FAILED": "FAILED",
    "RELEASE_FAILED": "FAILED",
    "ABORTED": "ABORTED",
}
BUCKETS = ["MIGRATED", "SKIPPED", "QUARANTINED", "PENDING", "FAILED", "ABORTED"]
LIVE_STATES = ["CREATED", "RELEASE_PENDING", "RELEASED"]

# Allowed state changes; a first state has no predecessor ("-").
ALLOWED_EDGES = {
    "-": ["EXTRACTED", "CLASSIFIED", "SKIPPED", "QUARANTINED"],
    "EXTRACTED": ["CLASSIFIED", "QUARANTINED"],
    "CLASSIFIED": ["SKIPPED", "QUARANTINED", "CREATE_PENDING"],
    "CREATE_PENDING": [
        "CREATED", "CREATE_FAILED", "PENDING_RESOLVED_EXISTS", "PENDING_RESOLVED_ABSENT",
    ],
    "PENDING_RESOLVED_EXISTS": ["CREATED"],
    "PENDING_RESOLVED_ABSENT": ["CREATE_PENDING"],
    "CREATE_FAILED": ["QUARANTINED"],
    "CREATED": ["RELEASE_PENDING", "ABORTED"],
    "RELEASE_PENDING": ["RELEASED", "RELEASE_FAILED", "ABORTED"],
    "RELEASE_FAILED": ["RELEASE_PENDING"],
    "QUARANTINED": ["CREATE_PENDING", "SKIPPED"],
}

ROW_KEY = ["run_id", "part", "source_line"]


def state_to_bucket(state: Column) -> Column:
    pairs = [F.lit(v) for pair in STATE_BUCKETS.items() for v in pair]
    return F.create_map(*pairs)[state]


# Columns of a folded row, and the sequence numbers it needs to be folded on.
FOLDED = [
    *ROW_KEY, "source_hash", "case_ref", "state", "target_element", "reason_code", "rule_ids", "detail",
    "instance_key", "last_seq", "n_events",
]
MARKS = ["first_classify", "last_classify", "detail_seq", "key_seq"]


def as_partial(events: DataFrame) -> DataFrame:
    """Each event as a fold of itself alone."""
    seq = F.col("seq")
    classify = F.when(F.col("kind") == "CLASSIFY", seq)
    return events.select(
        *[c for c in FOLDED if c not in ("last_seq", "n_events")],
        seq.alias("last_seq"),
        F.lit(1).cast("bigint").alias("n_events"),
        classify.alias("first_classify"),
        classify.alias("last_classify"),
        F.when((F.col("kind") == "CLASSIFY") | F.col("detail").isNotNull(), seq).alias("detail_seq"),
        F.when(F.col("instance_key").isNotNull(), seq).alias("key_seq"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Folds of any parts of a log to the fold of the whole, by aggregation only, so a
    key with very many events is combined on the map side. The parts may come in any
    order; an event that stands in two of them counts twice in ``n_events`` alone."""
    return partials.groupBy(*ROW_KEY).agg(
        F.min_by("source_hash", "first_classify").alias("source_hash"),
        F.min_by("case_ref", "first_classify").alias("case_ref"),
        F.max_by("state", "last_seq").alias("state"),
        F.max_by("target_element", "last_classify").alias("target_element"),
        F.max_by("reason_code", "last_classify").alias("reason_code"),
        F.max_by("rule_ids", "last_classify").alias("rule_ids"),
        F.max_by("detail", "detail_seq").alias("detail"),
        F.max_by("instance_key", "key_seq").alias("instance_key"),
        F.max("last_seq").alias("last_seq"),
        F.sum("n_events").alias("n_events"),
        F.min("first_classify").alias("first_classify"),
        F.max("last_classify").alias("last_classify"),
        F.max("detail_seq").alias("detail_seq"),
        F.max("key_seq").alias("key_seq"),
    )


def fold_ledger(events: DataFrame) -> DataFrame:
    """Current row per key.

    A classification overwrites target, reason, rules and detail, even with null.
    Later transitions change the detail only when they carry one. The instance
    key is never reset; hash and case reference keep their first value.
    """
    return merge_partials(as_partial(events)).select(*FOLDED)


def with_previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``prev_<column>`` and the 1-based ``position`` of each row within its
    key, in ``order``.

    Rows are partitioned by ranges of (keys, order) and written, so a key with a large
    share of the rows lies in many ranges, cut where it has rows. Windows run per range
    and key. One carry row per range and key, its count and its last values, is chained
    over the ranges, and what is carried into a range goes to the first row there. There
    are as many ranges as shuffle partitions, at every size. Rows that are equal in keys
    and order lie in one range.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, *keys, order)
    work = materialised(ranged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(order)
    local = work.withColumn("_at", F.row_number().over(inside))
    for c in columns:
        local = local.withColumn(f"_lag_{c}", F.lag(c).over(inside))

    last = [F.max_by(c, order).alias(f"_last_{c}") for c in columns]
    heads = work.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), *last)
    chain = Window.partitionBy(*keys).orderBy("_range")  # a row per range that holds the key
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(
        F.col("_range").alias("_in"),
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        *[F.lag(f"_last_{c}").over(chain).alias(f"_carry_{c}") for c in columns],
    )
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    first = F.col("_at") == 1
    return local.join(carried, same).select(
        *rows.columns,
        (F.col("_at") + F.col("_skip")).cast("bigint").alias("position"),
        *[
            F.when(first, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in columns
        ],
    )


def allowed_edges(spark: SparkSession) -> DataFrame:
    pairs = ", ".join(f"('{a}', '{b}')" for a, targets in ALLOWED_EDGES.items() for b in targets)
    return spark.sql(f"SELECT * FROM VALUES {pairs} AS t(from_state, to_state)")


def guarded(ledger: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed events with ``from_state`` and ``applied``: whether the state graph lets
    the row go there from where it is. Several events of a row are taken in the order of
    ``seq``; after one that is refused, the later ones are refused, too. A row that the
    folded ``ledger`` does not know has no state yet ("-")."""
    current = ledger.select(*ROW_KEY, F.col("state").alias("_now"))
    in_order = Window.partitionBy(*ROW_KEY).orderBy("seq")  # the few events of one row
    before = F.coalesce(F.lag("state").over(in_order), "_now", F.lit("-"))
    steps = proposed.join(current, ROW_KEY, "left").withColumn("from_state", before)
    pairs = [F.lit(x) for a, targets in ALLOWED_EDGES.items() for x in (a, F.array(*[F.lit(t) for t in targets]))]
    ok = F.coalesce(F.array_contains(F.create_map(*pairs)[F.col("from_state")], F.col("state")), F.lit(False))
    applied = F.bool_and("_ok").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("_ok", ok).withColumn("applied", applied).drop("_now", "_ok")


def illegal_transitions(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Consecutive states the state graph does not allow."""
    steps = with_previous(events.select(*ROW_KEY, "seq", "state"), ROW_KEY, "seq", ["state"]).select(
        *ROW_KEY,
        "seq",
        F.coalesce("prev_state", F.lit("-")).alias("from_state"),
        F.col("state").alias("to_state"),
    )
    # A fixed list of 22 edges.
    return steps.join(F.broadcast(allowed_edges(spark)), ["from_state", "to_state"], "left_anti")


def rows_in_state(ledger: DataFrame, run_id: str, state: str) -> DataFrame:
    return ledger.where((F.col("run_id") == run_id) & (F.col("state") == state)).orderBy(
        "part", "source_line"
    )


def bucket_counts(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    """Totals of the six buckets, zero-filled."""
    states = ledger.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    totals = states.groupBy(state_to_bucket(F.col("state")).alias("bucket")).agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    return (
        closed_list(spark, BUCKETS, "bucket")
        .join(totals, "bucket", "left")
        .select("bucket", F.coalesce("n", zero).alias("n"))
    )


def live_duplicates(ledger: DataFrame) -> DataFrame:
    """Case references with more than one live row in a run."""
    live = ledger.where(F.col("case_ref").isNotNull() & F.col("state").isin(LIVE_STATES))
    return live.groupBy("run_id", "case_ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distinct_case_refs(ledger: DataFrame) -> DataFrame:
    return ledger.where("case_ref is not null").select("run_id", "case_ref").distinct()


def start_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Run table after an insert; a run that is already there keeps its first row."""
    fields = [c for c in runs.columns if c != "run_id"]
    return (
        runs.unionByName(new)
        .groupBy("run_id")
        .agg(F.min_by(F.struct(*fields), "started_at").alias("row"))
        .select("run_id", "row.*")
    )


def close_creation(runs: DataFrame, run_id: str) -> DataFrame:
    closed = (F.col("run_id") == run_id) | F.col("creation_closed")
    return runs.withColumn("creation_closed", closed)


def open_run_rows(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that may still be created; a run nobody has recorded is open. All rows
    of a run share its id, so the run list is broadcast when it is small."""
    closed = broadcast_if_small(runs.where("creation_closed").select("run_id").distinct())
    return batch.join(closed, "run_id", "left_anti")
