"""Streaming jobs. Each takes streaming frames and starts one query; the batch
operators are reused unchanged. Paths must be on storage every executor reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from casegate.operators.ledger import (
    ALLOWED_EDGES,
    FOLDED,
    MARKS,
    ROW_KEY,
    STATE_BUCKETS,
    as_partial,
    fold_ledger,
    merge_partials,
    with_previous,
)
from casegate.operators.load import create_commands, intent_events, load_plan, refuse_creates
from casegate.plans.classify import classify
from casegate.session import broadcast_if_small, materialised
from casegate.sources.export import source_records
from casegate.sources.ledger_store import SNAPSHOT_SCHEMA
from casegate.sources.tables import LEDGER_SCHEMA


def _append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def _each_batch(
    stream: DataFrame, mode: str, checkpoint: str, work: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(work)
        .start()
    )


def stream_classify(
    lines: DataFrame, header: str, boundary: Column, path: str, checkpoint: str
) -> StreamingQuery:
    """Numbered raw lines in, placed records out. The decisions are a static side
    of at most 96 rows, so the stream keeps no state."""
    return _append(classify(source_records(lines, header), boundary), path, checkpoint)


def stream_visibility_timeout(
    created: DataFrame, exported: DataFrame, timeout: str, path: str, checkpoint: str, lag: str
) -> StreamingQuery:
    """Held instances against their export: visible within the timeout, or vanished.

    ``created`` has ``instance_key, created_at``; ``exported`` has ``exported_key,
    exported_at``. Rows may come up to ``lag`` behind the newest seen. An unmatched instance comes out once the watermark has passed
    its deadline, so lag and loss are told apart without polling.
    """
    left = created.withWatermark("created_at", lag)
    right = exported.withWatermark("exported_at", lag)
    in_time = F.expr(
        "exported_key = instance_key AND exported_at >= created_at "
        f"AND exported_at <= created_at + INTERVAL {timeout}"
    )
    seen = left.join(right, in_time, "left_outer").select(
        "instance_key", "created_at", F.col("exported_key").isNotNull().alias("visible")
    )
    return _append(seen, path, checkpoint)


# Batches after which the changes of a keyed state are merged into a snapshot.
MERGE_EVERY = 16


def _read(spark: SparkSession, schema: str, base: str, numbers: Iterable[int], name: str) -> DataFrame:
    """Numbered folders of one table; without any, no rows."""
    paths = [f"{base}/{name}={n}" for n in numbers]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


# States that no event leads on from.
FINAL_STATES = sorted(set(STATE_BUCKETS) - set(ALLOWED_EDGES))


class LedgerState:
    """The ledger's state from a stream of events, batch by batch, with expiry.

    Each batch is folded alone, into ``tail``. Every ``merge_every`` batches the tails are
    merged into ``live``, and rows that have been in a final state for ``ttl`` (in units
    of ``seq``, against the newest event) leave it for ``final``, which only grows and
    which no batch reads. Folds are merged in any order, so an event that comes for an
    expired row starts a new fold of that row and ``current`` puts both together.

    ``changed`` has, per batch, the rows that the batch changed, from what is live: an
    expired row that goes on shows there what came since. Folders carry the batch number
    and a batch reads only earlier ones, so a repeated batch writes the same rows again.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: int, merge_every: int = MERGE_EVERY) -> None:
        self.spark, self.path, self.ttl, self.merge_every = spark, path, ttl, merge_every

    def _merged(self, before: int) -> int:
        """The last batch before this one that merged; -1 without any."""
        return before // self.merge_every * self.merge_every - 1

    def live_before(self, batch: int) -> DataFrame:
        """Folds of the rows that are not expired, those of the tails apart."""
        merged = self._merged(batch)
        old = _read(self.spark, SNAPSHOT_SCHEMA, f"{self.path}/live", [merged] if merged >= 0 else [], "upto")
        return old.unionByName(_read(self.spark, SNAPSHOT_SCHEMA, f"{self.path}/tail", range(merged + 1, batch), "batch"))

    def work(self, events: DataFrame, batch: int) -> None:
        def write(frame: DataFrame, name: str, number: str = "batch") -> None:
            frame.select(*FOLDED, *MARKS).write.mode("overwrite").parquet(f"{self.path}/{name}/{number}={batch}")

        write(merge_partials(as_partial(events)), "tail")
        tail = _read(self.spark, SNAPSHOT_SCHEMA, f"{self.path}/tail", [batch], "batch")
        live = self.live_before(batch)
        write(merge_partials(live.join(tail.select(*ROW_KEY), ROW_KEY, "left_semi").unionByName(tail)), "changed")
        if batch % self.merge_every == self.merge_every - 1:
            rows = materialised(merge_partials(live.unionByName(tail)))
            newest = rows.agg(F.max("last_seq")).first()[0]
            old = F.lit(False) if newest is None else F.col("last_seq") <= newest - self.ttl
            expired = F.coalesce(F.col("state").isin(FINAL_STATES) & old, F.lit(False))
            write(rows.where(expired), "final", "upto")
            write(rows.where(~expired), "live", "upto")

    def current(self, batches: int) -> DataFrame:
        """The folded ledger after so many batches, expired rows included."""
        merges = range(self.merge_every - 1, batches, self.merge_every)
        final = _read(self.spark, SNAPSHOT_SCHEMA, f"{self.path}/final", merges, "upto")
        return merge_partials(final.unionByName(self.live_before(batches))).select(*FOLDED)


def stream_ledger_state(
    events: DataFrame, path: str, checkpoint: str, ttl: int, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Current state per ledger row; the rows that a batch changed are below
    ``path``/changed under its number, and ``LedgerState.current`` has all rows."""
    job = LedgerState(events.sparkSession, path, ttl, merge_every)
    return _each_batch(events, "append", checkpoint, job.work)


class VisibilityWatch:
    """Creates against the exports that show them, batch by batch, without losing what
    comes late.

    Rows have ``instance_key``, ``kind`` (CREATED or EXPORTED) and ``at`` (a number, the
    order). A create is visible when an export of its key follows within ``timeout``. It
    is decided once nothing up to its deadline can come any more, that is ``lag`` behind
    the newest row of the batches so far; until then it waits, and so do exports that
    may belong to it. Rows further behind are kept apart, under ``late``, and exports
    that showed no create in time under ``spare``; ``reconciled`` holds both against what
    was decided. A create without a key is never visible. Folders carry the batch number and a batch reads only earlier ones.
    """

    SCHEMA = "instance_key bigint, kind string, at bigint"
    DECIDED = "instance_key bigint, at bigint, visible boolean"

    def __init__(self, spark: SparkSession, path: str, timeout: int, lag: int) -> None:
        self.spark, self.path, self.timeout, self.lag = spark, path, timeout, lag

    def work(self, rows: DataFrame, batch: int, last: bool = False) -> None:
        """Decide what is ready; with ``last``, all that waits."""
        read = lambda schema, name: _read(self.spark, schema, f"{self.path}/{name}", [batch - 1] if batch else [], "batch")
        write = lambda frame, name: frame.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        head = read("cut bigint", "cuts").first()
        before = head["cut"] if head else None
        rows = materialised(rows.select("instance_key", "kind", F.col("at").cast("bigint").alias("at")))
        newest = rows.agg(F.max("at")).first()[0]
        cut = max((c for c in (before, None if newest is None else newest - self.lag) if c is not None), default=None)
        late = F.lit(False) if before is None else F.coalesce(F.col("at") <= before, F.lit(False))
        write(rows.where(late), "late")

        held = materialised(read(self.SCHEMA, "waiting").unionByName(rows.where(~late)))
        # Up to here creates are due, and later creates cannot be shown by exports from before.
        due = F.lit(True) if last else F.lit(False) if cut is None else F.col("at") <= cut - self.timeout
        creates, exports = held.where("kind = 'CREATED'"), held.where("kind = 'EXPORTED'")
        # A key's creates and exports lie side by side in the order, so each create asks for
        # the next export of its key and each export for the last create before it.
        ordered = held.withColumn("rank", F.struct("at", F.when(F.col("kind") == "CREATED", 0).otherwise(1)))
        # The few rows of one instance; rows without a key are dealt over many groups.
        keyed = Window.partitionBy("instance_key", F.when(F.col("instance_key").isNull(), F.col("at"))).orderBy("rank")
        next_export = F.first(F.when(F.col("kind") == "EXPORTED", F.col("at")), True).over(
            keyed.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        )
        last_create = F.last(F.when(F.col("kind") == "CREATED", F.col("at")), True).over(
            keyed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        seen = materialised(ordered.withColumn("next", next_export).withColumn("previous", last_create).drop("rank"))
        known = F.col("instance_key").isNotNull()
        visible = F.coalesce(known & (F.col("next") <= F.col("at") + self.timeout), F.lit(False))
        write(seen.where("kind = 'CREATED'").where(due).select("instance_key", "at", visible.alias("visible")), "decided")
        unused = F.coalesce(F.col("at") > F.col("previous") + self.timeout, F.lit(True))
        write(seen.where("kind = 'EXPORTED'").where(due & unused).select("instance_key", "kind", "at"), "spare")
        write(creates.where(~due).unionByName(exports.where(~due)), "waiting")
        write(self.spark.createDataFrame([(cut,)], "cut bigint"), "cuts")

    def finish(self) -> None:
        """After the stream has ended for good: decide what still waits."""
        done = self.spark.read.schema("cut bigint, batch bigint").parquet(f"{self.path}/cuts").agg(F.max("batch")).first()[0]
        self.work(self.spark.createDataFrame([], self.SCHEMA), done + 1, last=True)

    def reconciled(self) -> DataFrame:
        """Every create with its verdict: ``visible``, ``vanished``, ``appeared`` (a late
        row, or an export after the deadline, shows it after all) or ``late``."""
        table = lambda schema, name: self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}").drop("batch")
        late = table(self.SCHEMA, "late")
        shown = late.where("kind = 'EXPORTED'").unionByName(table(self.SCHEMA, "spare"))
        shown = shown.groupBy("instance_key").agg(F.max("at").alias("shown_at"))
        found = table(self.DECIDED, "decided").join(shown, "instance_key", "left")
        verdict = F.when(F.col("visible"), "visible").when(F.col("shown_at") >= F.col("at"), "appeared").otherwise("vanished")
        return found.select("instance_key", "at", verdict.alias("verdict")).unionByName(
            late.where("kind = 'CREATED'").select("instance_key", "at", F.lit("late").alias("verdict"))
        )


def stream_visibility_watch(events: DataFrame, path: str, checkpoint: str, timeout: int, lag: int) -> StreamingQuery:
    """Creates and exports in one stream (``VisibilityWatch.SCHEMA``), decided in batches."""
    return _each_batch(events, "append", checkpoint, VisibilityWatch(events.sparkSession, path, timeout, lag).work)


class UniqueActive:
    """Creates and ends of instances, batch by batch: which creates are accepted.

    A business id is active after any create and free after an end, so a create is
    accepted when the event before it in the order ``at`` is not a create. The state of
    the ids is a table below ``path``: each batch writes the ids that it changed, and
    every ``MERGE_EVERY`` batches they are merged into a snapshot of the ids that are
    active, so an id that was freed leaves the state.

    Events may come up to ``lag`` behind the newest of the batches before: they wait
    until nothing older can come, and are decided in order. What comes later than that
    is not decided but kept apart, under ``late``. Folders carry the batch number and a
    batch reads only earlier ones, so a repeated batch writes the same rows again.
    """

    STATE = "business_id string, active boolean, n bigint"

    def __init__(self, spark: SparkSession, schema: str, path: str, lag: int) -> None:
        self.spark, self.schema, self.path, self.lag = spark, schema, path, lag

    def cut_before(self, batch: int) -> int | None:
        """Events up to here were decided, or are late, when ``batch`` begins."""
        if batch == 0:
            return None
        return _read(self.spark, "cut bigint", f"{self.path}/cuts", [batch - 1], "batch").first()["cut"]

    def active_before(self, batch: int) -> DataFrame:
        """Ids that are active when ``batch`` begins."""
        merged = batch // MERGE_EVERY * MERGE_EVERY - 1  # the last batch that wrote a snapshot
        old = _read(self.spark, self.STATE, f"{self.path}/snapshot", [merged] if merged > 0 else [], "upto")
        new = _read(self.spark, self.STATE, f"{self.path}/changes", range(max(merged, -1) + 1, batch), "batch")
        latest = old.unionByName(new).groupBy("business_id").agg(F.max_by("active", "n").alias("active"))
        return latest.where("active").select("business_id")

    def work(self, rows: DataFrame, batch: int, last: bool = False) -> None:
        """Decide what is ready; with ``last``, all that waits."""
        before = self.cut_before(batch)
        waiting = _read(self.spark, self.schema, f"{self.path}/waiting", [batch - 1] if batch else [], "batch")
        rows = materialised(rows)
        newest = rows.agg(F.max("at")).first()[0]
        cuts = [c for c in (before, None if newest is None else newest - self.lag) if c is not None]
        cut = max(cuts, default=None)

        def write(frame: DataFrame, name: str, number: str = "batch") -> None:
            frame.write.mode("overwrite").parquet(f"{self.path}/{name}/{number}={batch}")

        late = F.lit(False) if before is None else F.col("at") <= before
        ready = F.lit(True) if last else F.lit(False) if cut is None else F.col("at") <= cut
        due = materialised(rows.where(~late).unionByName(waiting).where(ready))
        write(rows.where(late), "late")
        write(rows.where(~late).unionByName(waiting).where(~ready), "waiting")

        steps = with_previous(due, ["business_id"], "at", ["kind"])
        # Only an id's first event of the batch asks for the state: one row on either side.
        first = steps.where("position = 1").join(
            self.active_before(batch).withColumn("held", F.lit("CREATE")), "business_id", "left"
        )
        known = first.withColumn("prev_kind", F.col("held")).drop("held").unionByName(steps.where("position > 1"))
        free = F.coalesce(F.col("prev_kind") != "CREATE", F.lit(True))
        write(known.where("kind = 'CREATE'").withColumn("accepted", free).drop("kind", "position", "prev_kind"), "decided")
        last_kind = F.max_by("kind", "at") == "CREATE"
        write(due.groupBy("business_id").agg(last_kind.alias("active")).withColumn("n", F.lit(batch).cast("bigint")), "changes")
        if batch % MERGE_EVERY == MERGE_EVERY - 1:
            kept = self.active_before(batch).select("business_id", F.lit(True).alias("active"), F.lit(batch - 1).cast("bigint").alias("n"))
            changed = _read(self.spark, self.STATE, f"{self.path}/changes", [batch], "batch")
            merged = kept.unionByName(changed).groupBy("business_id").agg(F.max_by("active", "n").alias("active"), F.max("n").alias("n"))
            write(merged.where("active"), "snapshot", "upto")
        write(self.spark.createDataFrame([(cut,)], "cut bigint"), "cuts")

    def finish(self) -> None:
        """After the stream has ended for good: decide what still waits."""
        done = self.spark.read.schema("cut bigint, batch bigint").parquet(f"{self.path}/cuts").agg(F.max("batch")).first()[0]
        self.work(self.spark.createDataFrame([], self.schema), done + 1, last=True)


def stream_unique_active(events: DataFrame, path: str, checkpoint: str, lag: int) -> StreamingQuery:
    """One active instance per business id. ``events`` has ``business_id``, ``kind``
    (CREATE or END), ``at`` (a number, the order) and any other columns, which come out
    again with ``accepted`` below ``path``/decided; ``lag`` is in units of ``at``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    job = UniqueActive(events.sparkSession, schema, path, lag)
    return _each_batch(events, "append", checkpoint, job.work)


def stream_late_after_close(rows: DataFrame, runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every arriving create with whether its run had already closed creation.
    ``runs`` is the static run table; a run that is not in it is open."""
    closed = runs.where("creation_closed").select("run_id", F.lit(True).alias("closed")).distinct()
    flagged = rows.join(broadcast_if_small(closed), "run_id", "left").withColumn(
        "refused", F.coalesce("closed", F.lit(False))
    )
    return _append(flagged.drop("closed"), path, checkpoint)


def _planned(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the batch has a whole plan."""
    try:
        return spark.read.schema("n bigint").parquet(f"{path}/planned/batch={batch}").count() > 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


PLANNED_SCHEMA = "n bigint, first_part int, last_part int"


def _earlier_in_range(spark: SparkSession, path: str, batch: int, first: int | None, last: int | None) -> list[int]:
    """Batches before this one whose parts reach into the range; those that did not keep
    theirs may."""
    if batch == 0 or first is None:
        return []
    kept = spark.read.option("recursiveFileLookup", "true").schema(PLANNED_SCHEMA).parquet(f"{path}/planned")
    apart = (F.col("first_part") > last) | (F.col("last_part") < first)
    rows = kept.where((F.col("n") < batch) & ~F.coalesce(apart, F.lit(False))).select("n").distinct()
    return sorted(row["n"] for row in rows.collect())  # one row per batch, of those that overlap


def intent_first_batch(
    records: DataFrame, batch: int, boundary: Column, run_id: str, path: str,
    ledger: Callable[[], DataFrame] | None = None, closed: Callable[[], bool] | None = None,
) -> None:
    """One batch: its plan, then its intents, and only then the commands, which are read
    back from the plan.

    A plan that was written whole is kept: an attempt that died after it is taken up
    where it was, with the same creates, even if the run has been closed since. Else the
    batch is planned against ``ledger()``, the events so far, and the intents of the
    batches before it, both within the range of the batch's own parts: a plan is kept with
    that range, and intents of batches that lie outside are not opened. Once ``closed()`` holds, no create is planned: such rows have the action REFUSE_CLOSED.
    """
    spark = records.sparkSession
    plan_path = f"{path}/plan/batch={batch}"
    if not _planned(spark, path, batch):
        first, last = records.agg(F.min("part"), F.max("part")).first()
        events = ledger() if ledger else spark.createDataFrame([], LEDGER_SCHEMA)
        earlier = _earlier_in_range(spark, path, batch, first, last)
        events = events.unionByName(_read(spark, LEDGER_SCHEMA, f"{path}/intents", earlier, "batch"))
        own = F.col("part").between(F.lit(first), F.lit(last))
        folded = fold_ledger(events.where((F.col("run_id") == run_id) & own))
        plan = load_plan(classify(records, boundary), folded)
        if closed is not None and closed():
            plan = refuse_creates(plan)
        plan.write.mode("overwrite").parquet(plan_path)
        done = spark.createDataFrame([(batch, first, last)], PLANNED_SCHEMA)
        done.write.mode("overwrite").parquet(f"{path}/planned/batch={batch}")
    plan = spark.read.parquet(plan_path)
    intent_events(plan, run_id, 1).write.mode("overwrite").parquet(f"{path}/intents/batch={batch}")
    create_commands(plan, run_id).write.mode("overwrite").parquet(f"{path}/commands/batch={batch}")


def stream_intent_first(
    lines: DataFrame, header: str, boundary: Column, run_id: str, path: str, checkpoint: str,
    ledger: Callable[[], DataFrame] | None = None, closed: Callable[[], bool] | None = None,
) -> StreamingQuery:
    """Raw lines in, create commands out, never without their durable intents. Folders
    carry the batch number, so a repeated batch writes the same rows again. A row that is
    live or waits for an answer gets no second command."""

    def work(records: DataFrame, batch: int) -> None:
        intent_first_batch(records, batch, boundary, run_id, path, ledger, closed)

    return _each_batch(source_records(lines, header), "append", checkpoint, work)
