"""A run from classification to release, on tables in a folder.

``runs``, ``ledger`` and ``reports`` are Parquet folders below ``base``. Commands
come out as tables; whoever executes them hands back tables of answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from casegate.operators.decide import (
    TARGET_CONTRACT,
    available_variables,
    contract_lookup,
    contract_table,
    contract_unsatisfied,
    target_variables,
)
from casegate.operators.ledger import guarded
from casegate.operators.load import (
    apply_create_responses,
    create_commands,
    intent_events,
    load_plan,
    response_events,
)
from casegate.operators.reconcile import (
    abort_allowed,
    abort_set,
    abort_verify,
    checks_of,
    gate_block,
    gate_counts,
    quarantine_queue,
    release_plan,
    resolution_events,
    resolve_pending,
)
from casegate.operators.report import ANSWER_COUNTS, LOAD_COUNTS, RELEASE_COUNTS, classification_report, observed
from casegate.plans.classify import DryRun, dry_run, halt_on_expectation
from casegate.session import materialised
from casegate.sources.manifest import RunHalted, RunParameters
from casegate.sources.ledger_store import LedgerStore
from casegate.sources.tables import append_report, ledger_events

RUN_SCHEMA = (
    "run_id string, freeze_date date, cutoff_months int, header_hash string, "
    "record_count bigint, rules_hash string, creation_closed boolean, started_at timestamp"
)

REPORT_SCHEMA = "section string, key string, n bigint, block string, attempt bigint, run_id string"


class RunStore:
    """Where a run keeps its tables. The run table is an append-only log too: the
    first start counts, and one closing row closes the run."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.runs_path = f"{base}/runs"
        self.log = LedgerStore(spark, f"{base}/ledger")
        self.reports_path = f"{base}/reports"
        self.plans_path = f"{base}/plans"

    def _read(self, path: str, schema: str) -> DataFrame | None:
        """The table, or nothing if it has never been written."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def start(self, p: RunParameters, rules_hash: str) -> None:
        row = (
            p.run_id, p.freeze_date, p.cutoff_months, p.header_hash, p.record_count, rules_hash, False,
        )
        schema = RUN_SCHEMA.rsplit(",", 1)[0]
        self.spark.createDataFrame([row], schema).withColumn(
            "started_at", F.current_timestamp()
        ).write.mode("append").parquet(self.runs_path)

    def close(self, run_id: str) -> None:
        if self.row(run_id) is None:
            return
        self.run(run_id).withColumn("creation_closed", F.lit(True)).write.mode("append").parquet(self.runs_path)

    def run(self, run_id: str) -> DataFrame:
        """The run row: first start, closed once any row says so."""
        log = self.spark.read.schema(RUN_SCHEMA).parquet(self.runs_path)
        fields = ["freeze_date", "cutoff_months", "header_hash", "record_count", "rules_hash"]
        return (
            log.where(F.col("run_id") == run_id)
            .groupBy("run_id")
            .agg(
                *[F.min_by(c, "started_at").alias(c) for c in fields],
                F.bool_or("creation_closed").alias("creation_closed"),
                F.min("started_at").alias("started_at"),
            )
        )

    def row(self, run_id: str) -> Row | None:
        """The run row itself; nothing for a run nobody has started."""
        if self._read(self.runs_path, RUN_SCHEMA) is None:
            return None
        return self.run(run_id).first()

    def is_closed(self, run_id: str) -> bool:
        row = self.row(run_id)
        return bool(row and row["creation_closed"])

    def ledger(self, run_id: str) -> DataFrame:
        """The run's ledger as a plain table: whatever came since is folded in first,
        so plans may read it as often as they like."""
        return self.log.settled(run_id)

    def append(self, events: DataFrame) -> None:
        self.log.append(events)

    def apply(self, run_id: str, events: DataFrame, section: str = "", counts: dict[str, str] | None = None) -> DataFrame:
        """Append the events that the state graph allows, and return the refused ones.
        With ``counts``, what they count of the appended events is kept as a block."""
        judged = materialised(guarded(self.ledger(run_id), events))
        applied = judged.where("applied")
        if counts:
            self.report(observed(applied, section, counts, self.append), run_id, section)
        else:
            self.append(applied)
        return judged.where("not applied")

    def report(self, rows: DataFrame, run_id: str, block: str) -> None:
        """Keep a block of counts under the run."""
        kept = self._read(self.reports_path, REPORT_SCHEMA)
        last = None if kept is None else kept.where(F.col("run_id") == run_id).agg(F.max("attempt")).first()[0]
        append_report(rows, self.reports_path, run_id, block, (last or 0) + 1)

    def reports(self, run_id: str) -> DataFrame:
        """The last block of each name: section, key, n."""
        rows = self.spark.read.schema(REPORT_SCHEMA).parquet(self.reports_path).where(F.col("run_id") == run_id)
        last = rows.groupBy("block").agg(F.max("attempt").alias("attempt"))
        return rows.join(last, ["block", "attempt"], "left_semi").select("section", "key", "n")

    def next_seq(self) -> int:
        return self.log.next_seq()

    def planned(self, run_id: str) -> DataFrame:
        """The rows of the run's load plans, each as its last plan has it."""
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/load-(\d+)/", 1).cast("bigint")
        plans = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.plans_path}/{run_id}")
        fields = [F.col(c) for c in plans.columns if c not in ("part", "source_line")]
        last = F.max_by(F.struct(*fields), number).alias("row")
        return plans.groupBy("part", "source_line").agg(last).select("part", "source_line", "row.*")


def load_intents(store: RunStore, run: DryRun) -> DataFrame:
    """Write the plan of a load, then its intents, and return its create commands.
    Intents and commands both come from the written plan, so the export is
    classified once and no command can leave without its durable intent."""
    p = run.parameters
    store.start(p, run.rules_hash)
    if store.run(p.run_id).first()["rules_hash"] != run.rules_hash:
        raise RunHalted(f"run {p.run_id} was started with another rule table")
    if store.is_closed(p.run_id):
        raise RunHalted(f"run {p.run_id} has closed creation")
    seq = store.next_seq()
    path = f"{store.plans_path}/{p.run_id}/load-{seq}"
    planned = load_plan(run.classified, store.ledger(p.run_id))
    store.report(observed(planned, "load", LOAD_COUNTS, lambda rows: rows.write.mode("overwrite").parquet(path)), p.run_id, "load")
    plan = store.spark.read.parquet(path)
    store.append(intent_events(plan, p.run_id, seq))
    return create_commands(plan, p.run_id)


def record_responses(store: RunStore, run_id: str, commands: DataFrame, responses: DataFrame) -> DataFrame:
    """Take the answers into the ledger. An answer to a row that is no longer pending is
    refused; the refused events are returned."""
    seq = store.next_seq()
    events = response_events(apply_create_responses(commands, responses), run_id, seq)
    return store.apply(run_id, events, "answers", ANSWER_COUNTS)


def resolve_creates(store: RunStore, run_id: str, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle creates without a final answer against a snapshot taken after the re-check
    window. Returns the resolutions and the commands of the creates to try again, whose
    intents are in the ledger by then. Once creation is closed nothing is tried again."""
    resolved = materialised(resolve_pending(store.ledger(run_id), active))
    if store.is_closed(run_id):
        resolved = resolved.where("resolution <> 'RETRY'")
    store.apply(run_id, resolution_events(resolved, store.next_seq()))
    again = resolved.where("resolution = 'RETRY'").select("part", "source_line")
    rows = store.planned(run_id).join(again, ["part", "source_line"], "left_semi")
    return resolved, create_commands(rows.withColumn("action", F.lit("CREATE")), run_id)


def gate(store: RunStore, run_id: str, active: DataFrame) -> DataFrame:
    """Stop new creates, then run the checks over what there is, in one pass that the
    gate's block comes from, too. A run that was never started has no gate."""
    row = store.row(run_id)
    if row is None:
        raise RunHalted(f"run {run_id} was never started")
    store.close(run_id)
    counts = materialised(gate_counts(store.ledger(run_id), active))
    store.report(gate_block(counts, row["record_count"]), run_id, "gate")
    return checks_of(counts, row["record_count"])


def release_intents(store: RunStore, run_id: str, checks: DataFrame) -> DataFrame:
    """Write release intents for held rows if the gate passed; returns the commands.
    Like the creates, the commands are read back from the durable intents."""
    seq = store.next_seq()
    plan = release_plan(store.ledger(run_id), checks).where("action = 'RELEASE'")
    store.append(
        ledger_events(
            plan.select(
                "run_id",
                "part",
                "source_line",
                F.lit("TRANSITION").alias("kind"),
                F.lit("RELEASE_PENDING").alias("state"),
                F.lit(seq).alias("seq"),
            )
        )
    )
    current = store.ledger(run_id)
    return current.where((F.col("state") == "RELEASE_PENDING") & (F.col("last_seq") == seq)).select(
        "run_id", "part", "source_line", "instance_key", "target_element"
    )


def record_releases(store: RunStore, run_id: str, answers: DataFrame) -> DataFrame:
    """``answers``: key, ``ok`` and ``message`` per release command that was answered.
    Returns the events that the state graph refuses."""
    seq = store.next_seq()
    state = F.when(F.col("ok"), "RELEASED").otherwise("RELEASE_FAILED")
    return store.apply(
        run_id,
        ledger_events(
            answers.select(
                F.lit(run_id).alias("run_id"),
                "part",
                "source_line",
                F.lit("TRANSITION").alias("kind"),
                state.alias("state"),
                F.when(~F.col("ok"), F.col("message")).alias("detail"),
                F.lit(seq).alias("seq"),
            )
        ),
        "release",
        RELEASE_COUNTS,
    )


def record_resolutions(store: RunStore, run_id: str, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take operators' decisions on quarantined rows into the ledger: a chosen target
    becomes a create intent, the others are skipped. ``resolutions`` has the row key,
    ``decision`` (TARGET or SKIP) and ``chosen_target``. A target must be one that cases
    can be placed on, and once creation is closed none can be chosen.

    Returns the rows whose case lacks a variable that its chosen target requires, which
    stay in quarantine, and the create commands of the others. Their rows are written as
    a plan of their own first, so a later retry creates them at the chosen target."""
    chosen = resolutions.where("decision = 'TARGET'")
    if chosen.where(~F.coalesce(F.col("chosen_target").isin(list(TARGET_CONTRACT)), F.lit(False))).limit(1).count():
        raise RunHalted(f"run {run_id}: a chosen target is not one that cases can be placed on")
    if store.is_closed(run_id) and chosen.limit(1).count():
        raise RunHalted(f"run {run_id} has closed creation")
    seq = store.next_seq()
    queue = materialised(quarantine_queue(store.ledger(run_id), resolutions).where("next_state <> 'QUARANTINED'"))
    creates = queue.where("next_state = 'CREATE_PENDING'").select("part", "source_line", F.col("next_target").alias("target_element"))
    planned = store.planned(run_id)
    placed = contract_lookup(planned.drop("target_element").join(creates, ["part", "source_line"]), contract_table(store.spark))
    judged = placed.withColumn("lacks", contract_unsatisfied(F.col("required_bits")))
    variables = target_variables(F.col("required"), available_variables())
    rows = judged.withColumns({"target_variables": variables, "action": F.lit("CREATE"), "next_state": F.lit("CREATE_PENDING")})
    rows = materialised(rows.select(*planned.columns, "lacks"))
    path = f"{store.plans_path}/{run_id}/load-{seq}"
    rows.where("not lacks").drop("lacks").write.mode("overwrite").parquet(path)
    refused = rows.where("lacks").select("part", "source_line", "target_element")
    decided = queue.join(refused, ["part", "source_line"], "left_anti")
    store.apply(
        run_id,
        ledger_events(
            decided.select(
                "run_id",
                "part",
                "source_line",
                F.lit("CLASSIFY").alias("kind"),
                "source_hash",
                "case_ref",
                F.col("next_state").alias("state"),
                F.col("next_target").alias("target_element"),
                "reason_code",
                "rule_ids",
                F.lit(seq).alias("seq"),
            )
        ),
    )
    return refused, create_commands(store.spark.read.schema(planned.schema).parquet(path), run_id)


def abort(store: RunStore, run_id: str, active: DataFrame) -> DataFrame:
    """The instances to cancel, or a halt once anything is released."""
    ledger = store.ledger(run_id)
    guard = abort_allowed(ledger).first()
    if guard and not guard["allowed"]:
        raise RunHalted(f"{guard['n_released']} case(s) already released")
    return abort_set(ledger, active)


def record_aborts(store: RunStore, run_id: str, cancelled: DataFrame, later: DataFrame) -> DataFrame:
    """Mark what is confirmed gone; returns the verification."""
    verified = abort_verify(cancelled, later)
    seq = store.next_seq()
    gone = verified.where("result = 'ABORTED'").select(
        F.lit(run_id).alias("run_id"),
        "part",
        "source_line",
        F.lit("TRANSITION").alias("kind"),
        F.lit("ABORTED").alias("state"),
        F.lit(seq).alias("seq"),
    )
    store.apply(run_id, ledger_events(gone))
    return verified


def migrate(
    store: RunStore, export: str, manifest: str, expected: DataFrame | None = None
) -> tuple[DryRun, DataFrame | None]:
    """Classify, stop on a missed expectation, keep the counts, and plan the load
    unless creation is already closed. Returns the dry run and the commands."""
    run = dry_run(store.spark, export, manifest)
    if expected is not None:
        halt_on_expectation(run.classified, expected)
    report = classification_report(store.spark, run.classified)
    store.report(report, run.parameters.run_id, "classification")
    closed = store.is_closed(run.parameters.run_id)
    return run, None if closed else load_intents(store, run)


def run_to_end(
    store: RunStore,
    export: str,
    manifest: str,
    create: Callable[[DataFrame], DataFrame],
    snapshot: Callable[[], DataFrame],
    release: Callable[[DataFrame], DataFrame] | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """A whole run: classify, load, gate and, if asked to, release. ``create`` and
    ``release`` execute a table of commands and return the answers, ``snapshot`` gives
    the active instances. Rows are released only if the gate passes; a run whose creation
    is closed goes straight to the gate. Returns the reports of the run."""
    run, commands = migrate(store, export, manifest, expected)
    run_id = run.parameters.run_id
    if commands is not None:
        sent = materialised(commands)
        record_responses(store, run_id, sent, create(sent))
    checks = materialised(gate(store, run_id, snapshot()))
    if release is not None:
        to_release = materialised(release_intents(store, run_id, checks))
        record_releases(store, run_id, release(to_release))
    return store.reports(run_id)
