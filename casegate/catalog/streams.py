"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from casegate.catalog import bindings as b
from casegate.catalog import oracle as o
from casegate.catalog import reconciliation as r
from casegate.catalog.registry import ORACLES, query
from casegate.sources.tables import LEDGER_SCHEMA
from casegate.streaming import jobs

LINES_SCHEMA = "part int, source_line bigint, raw string"


def _run(
    spark: SparkSession, sf: str, name: str, start: Callable[[str, str], StreamingQuery]
) -> str:
    """Run a stream over everything there is, once, and return its output path."""

    def write(path: str) -> None:
        start(path, f"{path}-checkpoint").awaitTermination()

    return b.written(spark, sf, name, write)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    path = b.lines_path(spark, sf)
    return spark.readStream.schema(LINES_SCHEMA).option("maxFilesPerTrigger", 4).parquet(path)


def _files(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> str:
    return b.written(spark, sf, name, lambda path: make().repartition(4).write.parquet(path))


@query(
    "stream_classify",
    f"{o.WITH_CLASSIFIED} SELECT part, source_line, source_hash, outcome, target_element, reason_code FROM classified",
)
def stream_classify(spark, sf):
    lines = _lines(spark, sf)
    path = _run(
        spark, sf, "stream-classify",
        lambda path, check: jobs.stream_classify(lines, b.header(spark, sf), b.boundary(), path, check),
    )
    return spark.read.parquet(path).select(
        "part", "source_line", "source_hash", "outcome", "target_element", "reason_code"
    )


# Time after which a row in a final state leaves the live state, and batches per merge.
STATE_TTL, STATE_MERGE, STATE_BATCHES = 3_600_000_000, 2, 5


@query("stream_ledger_state", ORACLES["ledger_fold"])
def stream_ledger_state(spark, sf):
    """Five batches in time order; rows that ended an hour ago expire, and go on later."""

    def deliver(path: str) -> None:
        log = b.user_events(spark, sf)
        low, high = log.agg(F.min("seq"), F.max("seq")).first()
        for i in range(STATE_BATCHES):
            at = F.call_function("div", (F.col("seq") - low) * STATE_BATCHES, F.lit(high - low + 1))
            log.where(at == i).coalesce(1).write.mode("append").parquet(path)

    source = b.written(spark, sf, "stream-events", deliver)
    events = spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    path = _run(
        spark, sf, "stream-ledger",
        lambda path, check: jobs.stream_ledger_state(events, path, check, STATE_TTL, STATE_MERGE),
    )
    state = jobs.LedgerState(spark, path, STATE_TTL, STATE_MERGE)
    done = spark.read.parquet(f"{path}/tail").agg(F.max("batch")).first()[0]
    return state.current(0 if done is None else done + 1).drop("reason_code", "rule_ids")


@query(
    "stream_visibility_timeout",
    "SELECT event_id AS instance_key, event_id % 13 <> 0 AND event_id % 60 <= 30 AS visible FROM events WHERE event_type = 'click'",
)
def stream_visibility_timeout(spark, sf):
    """Clicks are creates; their exports follow late, or never. A closing heartbeat
    in each stream moves the watermark past the last deadline."""

    def created() -> DataFrame:
        clicks = b.table(spark, sf, "events").where("event_type = 'click'").select(
            F.col("event_id").alias("instance_key"), F.col("ts").cast("timestamp").alias("created_at")
        )
        beat = clicks.agg(
            F.lit(-1).cast("bigint").alias("instance_key"),
            (F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
        )
        return clicks.unionByName(beat)

    def exported() -> DataFrame:
        seconds = F.when(F.col("instance_key") < 0, 0).otherwise(F.col("instance_key") % 60)
        shown = created().where("instance_key < 0 or instance_key % 13 <> 0")
        at = F.timestamp_micros(F.unix_micros("created_at") + seconds * 1_000_000)
        return shown.select(F.col("instance_key").alias("exported_key"), at.alias("exported_at"))

    left = spark.readStream.schema("instance_key bigint, created_at timestamp").parquet(
        _files(spark, sf, "stream-created", created)
    )
    right = spark.readStream.schema("exported_key bigint, exported_at timestamp").parquet(
        _files(spark, sf, "stream-exported", exported)
    )
    path = _run(
        spark, sf, "stream-visibility",
        lambda path, check: jobs.stream_visibility_timeout(left, right, "30 SECONDS", path, check, "10 minutes"),
    )
    return spark.read.parquet(path).where("instance_key >= 0").select("instance_key", "visible")


# Signups and purchases are delivered in five slices of time, each up to six minutes
# late; every 97th comes with the last slice, however old it is.
SLICES, LAG = 5, 600_000_000
UNIQUE_SQL = f"""WITH log AS (
  SELECT event_id, 'LP-' || user_id AS business_id, event_type, epoch_us(ts) AS t FROM events WHERE event_type IN ('signup', 'purchase')),
bounds AS (SELECT min(t) AS low, max(t) AS high FROM log),
sliced AS (SELECT log.*, CASE WHEN event_id % 97 = 0 THEN {SLICES - 1}
    ELSE least((t + (event_id % 7) * 60000000 - low) * {SLICES} // (high - low + 1), {SLICES - 1}) END AS slice FROM log, bounds),
seen AS (SELECT max(t) - {LAG} AS cut FROM sliced WHERE slice < {SLICES - 1}),
placed AS (SELECT sliced.*, slice = {SLICES - 1} AND t <= cut AS late FROM sliced, seen),
steps AS (SELECT *, lag(event_type) OVER (PARTITION BY business_id ORDER BY t) AS prev FROM placed WHERE NOT late)
SELECT event_id, business_id, CASE WHEN coalesce(prev, 'purchase') <> 'signup' THEN 'accepted' ELSE 'refused' END AS verdict
FROM steps WHERE event_type = 'signup'
UNION ALL SELECT event_id, business_id, 'late' FROM placed WHERE late"""


# Clicks are creates, and the exports that show most of them follow within a minute.
TIMEOUT = 30_000_000
WATCH_SQL = f"""WITH log AS (
  SELECT event_id, 'CREATED' AS kind, epoch_us(ts) AS t FROM events WHERE event_type = 'click'
  UNION ALL SELECT event_id, 'EXPORTED', epoch_us(ts) + event_id % 60 * 1000000 FROM events WHERE event_type = 'click' AND event_id % 13 <> 0),
bounds AS (SELECT min(t) AS low, max(t) AS high FROM log),
sliced AS (SELECT log.*, CASE WHEN event_id % CASE kind WHEN 'CREATED' THEN 97 ELSE 19 END = 0 THEN {SLICES - 1}
    ELSE least((t + (event_id % 7) * 60000000 - low) * {SLICES} // (high - low + 1), {SLICES - 1}) END AS slice FROM log, bounds),
seen AS (SELECT max(t) - {LAG} AS cut FROM sliced WHERE slice < {SLICES - 1}),
placed AS (SELECT sliced.*, slice = {SLICES - 1} AND t <= cut AS late FROM sliced, seen)
SELECT c.event_id AS instance_key, CASE WHEN c.late THEN 'late' WHEN e.event_id IS NULL THEN 'vanished'
  WHEN NOT e.late AND e.t <= c.t + {TIMEOUT} THEN 'visible' ELSE 'appeared' END AS verdict
FROM (SELECT * FROM placed WHERE kind = 'CREATED') c LEFT JOIN (SELECT * FROM placed WHERE kind = 'EXPORTED') e USING (event_id)"""


@query("stream_visibility_watch", WATCH_SQL)
def stream_visibility_watch(spark, sf):
    """Five batches out of order: creates that are seen in time, seen after all, lost, or
    themselves too late. Every 19th export comes with the last batch."""

    def deliver(path: str) -> None:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        clicks = b.table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("instance_key"), at.alias("at"))
        shown = clicks.where("instance_key % 13 <> 0").withColumn("at", F.col("at") + F.col("instance_key") % 60 * 1_000_000)
        log = clicks.withColumn("kind", F.lit("CREATED")).unionByName(shown.withColumn("kind", F.lit("EXPORTED")))
        low, high = log.agg(F.min("at"), F.max("at")).first()
        arrives = F.col("at") + F.col("instance_key") % 7 * 60_000_000
        number = F.call_function("div", (arrives - low) * SLICES, F.lit(high - low + 1))
        held = F.col("instance_key") % F.when(F.col("kind") == "CREATED", 97).otherwise(19) == 0
        slice_ = F.when(held, SLICES - 1).otherwise(F.least(number, F.lit(SLICES - 1)))
        for i in range(SLICES):
            log.where(slice_ == i).select("instance_key", "kind", "at").coalesce(1).write.mode("append").parquet(path)

    source = b.written(spark, sf, "stream-watched", deliver)
    events = spark.readStream.schema(jobs.VisibilityWatch.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    path = _run(
        spark, sf, "stream-watch",
        lambda path, check: jobs.stream_visibility_watch(events, path, check, TIMEOUT, LAG),
    )
    watch = jobs.VisibilityWatch(spark, path, TIMEOUT, LAG)
    b.written(spark, sf, "stream-watch-end", lambda _: watch.finish())
    return watch.reconciled().select("instance_key", "verdict")


@query("stream_unique_active", UNIQUE_SQL)
def stream_unique_active(spark, sf):
    """A signup creates an instance and a purchase ends it, over several batches that
    are out of order: accepted and refused creates, and events too late to decide."""

    def deliver(path: str) -> None:
        log = b.table(spark, sf, "events").where("event_type in ('signup', 'purchase')").select(
            "event_id",
            F.concat(F.lit("LP-"), F.col("user_id").cast("string")).alias("business_id"),
            F.when(F.col("event_type") == "signup", "CREATE").otherwise("END").alias("kind"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        )
        low, high = log.agg(F.min("at"), F.max("at")).first()
        arrives = F.col("at") + F.col("event_id") % 7 * 60_000_000
        number = F.call_function("div", (arrives - low) * SLICES, F.lit(high - low + 1))
        slice_ = F.when(F.col("event_id") % 97 == 0, SLICES - 1).otherwise(F.least(number, F.lit(SLICES - 1)))
        for i in range(SLICES):
            log.where(slice_ == i).coalesce(1).write.mode("append").parquet(path)

    source = b.written(spark, sf, "stream-creates", deliver)
    schema = "event_id bigint, business_id string, kind string, at bigint"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = _run(
        spark, sf, "stream-unique",
        lambda path, check: jobs.stream_unique_active(events, path, check, LAG),
    )
    b.written(spark, sf, "stream-unique-end", lambda _: jobs.UniqueActive(spark, schema, path, LAG).finish())
    decided, late = spark.read.parquet(f"{path}/decided"), spark.read.parquet(f"{path}/late")
    verdict = F.when(F.col("accepted"), "accepted").otherwise("refused")
    return decided.select("event_id", "business_id", verdict.alias("verdict")).unionByName(
        late.select("event_id", "business_id", F.lit("late").alias("verdict"))
    )


@query(
    "stream_late_after_close",
    f"WITH {r.RUNS_SQL} SELECT o_orderkey, run_id, run_id IN (SELECT run_id FROM runs WHERE creation_closed) AS refused "
    "FROM (SELECT o_orderkey, strftime(o_orderdate, 'run-%Y-%m') AS run_id FROM orders)",
)
def stream_late_after_close(spark, sf):
    def rows() -> DataFrame:
        return b.table(spark, sf, "orders").select(
            "o_orderkey", F.date_format("o_orderdate", "'run-'yyyy-MM").alias("run_id")
        )

    runs = spark.read.parquet(
        b.written(spark, sf, "runs", lambda path: r._runs(spark, sf).write.parquet(path))
    )
    stream = spark.readStream.schema("o_orderkey bigint, run_id string").parquet(
        _files(spark, sf, "stream-orders", rows)
    )
    path = _run(
        spark, sf, "stream-late",
        lambda path, check: jobs.stream_late_after_close(stream, runs, path, check),
    )
    return spark.read.parquet(path)


@query(
    "stream_intent_first",
    f"{o.WITH_LEDGER}, both_runs AS (SELECT *, 'open' AS run FROM answered UNION ALL SELECT * REPLACE (CASE action WHEN 'CREATE' THEN 'REFUSE_CLOSED' ELSE action END AS action), 'closed' FROM answered) "
    "SELECT run, part, source_line, case_ref AS business_id, action, action = 'CREATE' AS commanded, "
    "CASE WHEN action = 'CREATE' THEN 2 WHEN action IN ('RECORD_SKIP', 'RECORD_QUARANTINE') THEN 1 ELSE 0 END AS n_intents FROM both_runs",
)
def stream_intent_first(spark, sf):
    """What became of every record against the events of an earlier load, in a run that
    is open and in one that has closed creation: whether a command left, and how many
    durable intents stand before it."""
    lines = _lines(spark, sf)
    earlier = spark.read.schema(LEDGER_SCHEMA).parquet(b.prior_path(spark, sf))

    def results(run: str, closed: bool) -> DataFrame:
        path = _run(
            spark, sf, f"stream-intent-{run}",
            lambda path, check: jobs.stream_intent_first(
                lines, b.header(spark, sf), b.boundary(), b.RUN_ID, path, check,
                ledger=lambda: earlier, closed=lambda: closed,
            ),
        )
        key = ["part", "source_line"]
        intents = spark.read.parquet(f"{path}/intents").groupBy(*key).agg(F.count(F.lit(1)).alias("n_intents"))
        commands = spark.read.parquet(f"{path}/commands").select(*key, F.lit(True).alias("commanded"))
        rows = spark.read.parquet(f"{path}/plan").join(intents, key, "left").join(commands, key, "left")
        return rows.select(
            F.lit(run).alias("run"), *key, F.col("case_ref").alias("business_id"), "action",
            F.coalesce("commanded", F.lit(False)).alias("commanded"),
            F.coalesce("n_intents", F.lit(0).cast("bigint")).alias("n_intents"),
        )

    return results("open", False).unionByName(results("closed", True))
