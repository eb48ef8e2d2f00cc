"""Planning the creates of a run and applying the answers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegate.functions.text import blank_to_null
from casegate.functions.values import join_rule_ids
from casegate.operators.decide import create_payload
from casegate.operators.ledger import LIVE_STATES
from casegate.sources.tables import ledger_events

KEY = ["part", "source_line"]


def existing_state_join(classified: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each classification with what the ledger already says about it."""
    current = ledger.select(*KEY, F.col("state").alias("existing_state"))
    return classified.join(current, KEY, "left")


def load_plan(classified: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``action`` and ``next_state``. A live row is left alone; a row whose
    create was never answered is refused, never repeated."""
    outcome, existing = F.col("outcome"), F.col("existing_state")
    action = (
        F.when(outcome == "SKIP", "RECORD_SKIP")
        .when(outcome == "QUARANTINE", "RECORD_QUARANTINE")
        .when(existing.isin(LIVE_STATES), "ALREADY_LOADED")
        .when(existing == "CREATE_PENDING", "REFUSE_PENDING")
        .otherwise("CREATE")
    )
    next_state = (
        F.when(F.col("action") == "RECORD_SKIP", "SKIPPED")
        .when(F.col("action") == "RECORD_QUARANTINE", "QUARANTINED")
        .when(F.col("action") == "CREATE", "CREATE_PENDING")
        .otherwise(existing)
    )
    return (
        existing_state_join(classified, ledger)
        .withColumn("action", action)
        .withColumn("next_state", next_state)
    )


def refuse_creates(plan: DataFrame) -> DataFrame:
    """The plan of a run that has closed creation: what it would create is refused and
    stays where it is; all else is recorded as before."""
    create = F.col("action") == "CREATE"
    next_state = F.when(create, F.col("existing_state")).otherwise(F.col("next_state"))
    return plan.withColumns({"next_state": next_state, "action": F.when(create, "REFUSE_CLOSED").otherwise(F.col("action"))})


def intent_events(plan: DataFrame, run_id: str, first_seq: int) -> DataFrame:
    """Events to append before anything is created: the classification, and for a
    create also its intent. Rows left alone write nothing."""

    def event(kind: str, state: Column | str, step: int) -> Column:
        value = F.lit(state) if isinstance(state, str) else state
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("state"), F.lit(first_seq + step).alias("seq")
        )

    steps = F.when(
        F.col("action") == "CREATE",
        F.array(
            event("CLASSIFY", "CLASSIFIED", 0), event("TRANSITION", "CREATE_PENDING", 1)
        ),
    ).otherwise(F.array(event("CLASSIFY", F.col("next_state"), 0)))
    written = plan.where(F.col("action").isin("RECORD_SKIP", "RECORD_QUARANTINE", "CREATE"))
    rows = written.select("*", F.explode(steps).alias("step")).select(
        F.lit(run_id).alias("run_id"),
        *KEY,
        "source_hash",
        blank_to_null(F.col("case_ref")).alias("case_ref"),
        "target_element",
        "reason_code",
        join_rule_ids(F.col("rule_ids")).alias("rule_ids"),
        F.when(F.col("step.kind") == "CLASSIFY", F.col("detail")).alias("detail"),
        "step.kind",
        "step.state",
        "step.seq",
    )
    return ledger_events(rows)


def create_commands(plan: DataFrame, run_id: str) -> DataFrame:
    """The create command table: business id and variables of every case to create."""
    return plan.where("action = 'CREATE'").select(
        F.lit(run_id).alias("run_id"),
        *KEY,
        F.col("case_ref").alias("business_id"),
        "target_element",
        create_payload(run_id).alias("payload"),
    )


def response_state(code: Column, message: Column) -> Column:
    """A refusal as duplicate proves the instance exists; no answer proves nothing."""
    exists = (code == 409) | F.coalesce(message.contains("ALREADY_EXISTS"), F.lit(False))
    return (
        F.when(code.isNull(), "CREATE_PENDING")
        .when(code == 200, "CREATED")
        .when(exists, "PENDING_RESOLVED_EXISTS")
        .otherwise("CREATE_FAILED")
    )


def apply_create_responses(commands: DataFrame, responses: DataFrame) -> DataFrame:
    """Commands with the state each answer leads to. ``responses`` has one row per
    answered command: key, ``code``, ``message``, ``instance_key``."""
    answered = commands.join(responses.select(*KEY, "code", "message", "instance_key"), KEY, "left")
    state = response_state(F.col("code"), F.col("message"))
    answered = answered.withColumn("state", state)
    known = F.when(F.col("state") == "CREATED", F.col("instance_key"))
    return answered.withColumn("instance_key", known)


def response_events(applied: DataFrame, run_id: str, seq: int) -> DataFrame:
    """Events to append for the answers; an unanswered command writes none."""
    detail = F.when(F.col("state") == "CREATE_FAILED", F.col("message")).when(
        F.col("state") == "PENDING_RESOLVED_EXISTS", F.lit("DUPLICATE_REFUSED")
    )
    rows = applied.where("state <> 'CREATE_PENDING'").select(
        F.lit(run_id).alias("run_id"),
        *KEY,
        F.when(F.col("state") == "CREATED", "CONFIRM").otherwise("TRANSITION").alias("kind"),
        "state",
        detail.alias("detail"),
        "instance_key",
        F.lit(seq).alias("seq"),
    )
    return ledger_events(rows)


def load_result(plan: DataFrame, applied: DataFrame) -> DataFrame:
    """One row of counts over what the load did."""
    done = plan.select(*KEY, "action").join(applied.select(*KEY, "state"), KEY, "left")
    action, state = F.col("action"), F.col("state")
    return done.agg(
        F.count_if(state == "CREATED").alias("created"),
        F.count_if(action == "RECORD_SKIP").alias("skipped"),
        F.count_if(action == "RECORD_QUARANTINE").alias("quarantined"),
        F.count_if(action == "ALREADY_LOADED").alias("already_loaded"),
        F.count_if(state == "PENDING_RESOLVED_EXISTS").alias("already_existed"),
        F.count_if(
            (action == "REFUSE_PENDING") | state.isin("CREATE_FAILED", "CREATE_PENDING")
        ).alias("failed"),
    )
