"""The ledger as a log of committed batches and a snapshot that follows it.

A batch of events is written first and committed by a row of its own, so readers see
whole batches only. The snapshot holds the fold of all batches up to one of them, run by
run; what came after is folded into it when the tail is long, for the runs in the tail
alone. Sequence numbers come from the commits, without a scan of the events.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from casegate.operators.ledger import FOLDED, MARKS, ROW_KEY, as_partial, merge_partials
from casegate.session import tasks_for
from casegate.sources.manifest import RunHalted
from casegate.sources.tables import LEDGER_SCHEMA, ledger_events

SNAPSHOT_SCHEMA = (
    "run_id string, part int, source_line bigint, source_hash string, case_ref string, state string, "
    "target_element string, reason_code string, rule_ids string, detail string, instance_key bigint, "
    "last_seq bigint, n_events bigint, first_classify bigint, last_classify bigint, detail_seq bigint, key_seq bigint"
)
COMMIT_SCHEMA = "batch bigint, last_seq bigint, n_events bigint"
KEPT_SCHEMA = "run_id string, upto bigint"
# Batches after which the tail is folded into the snapshot.
MERGE_EVERY = 8


class LedgerStore:
    """Events below ``path``: ``log/batch=<n>``, ``commits/batch=<n>``, ``snapshot/upto=<n>``
    and ``kept/upto=<n>``, which commits a snapshot and names the runs in it."""

    def __init__(self, spark: SparkSession, path: str, merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.merge_every = spark, path.rstrip("/"), merge_every

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], schema)
        return found

    def _head(self) -> Row:
        """Number, and last sequence number, of what is committed."""
        return self._table("commits", COMMIT_SCHEMA).agg(
            F.coalesce(F.max("batch"), F.lit(-1)).alias("batch"), F.coalesce(F.max("last_seq"), F.lit(0)).alias("last_seq")
        ).first()

    def next_seq(self) -> int:
        """The first sequence number that no committed event has."""
        return self._head()["last_seq"] + 1

    def append(self, events: DataFrame) -> int:
        """Write and commit one batch; returns its number. What an attempt that died
        before its commit left behind is overwritten, and of two writers of one number
        the second fails."""
        batch = self._head()["batch"] + 1
        path = f"{self.path}/log/batch={batch}"
        ledger_events(events).write.mode("overwrite").option("compression", "zstd").partitionBy("run_id").parquet(path)
        written = self.spark.read.schema(LEDGER_SCHEMA).parquet(path)
        last, n = written.agg(F.coalesce(F.max("seq"), F.lit(0)), F.count(F.lit(1))).first()
        self._commit(f"commits/batch={batch}", [(batch, last, n)], COMMIT_SCHEMA)
        if batch - self._upto() >= self.merge_every:
            self.compact()
        return batch

    def _commit(self, name: str, rows: list[tuple], schema: str) -> None:
        try:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("error").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_ALREADY_EXISTS":
                raise RunHalted(f"another writer has committed {name}") from error
            raise

    def _upto(self) -> int:
        last = self._table("kept", KEPT_SCHEMA).agg(F.max("upto").alias("upto")).first()["upto"]
        return -1 if last is None else last

    def _log(self, after: int, run_id: str | None = None) -> DataFrame:
        """Events of the committed batches after one of them."""
        head = self._table("commits", COMMIT_SCHEMA).where(F.col("batch") > after)
        numbers = sorted(r["batch"] for r in head.where("n_events > 0").select("batch").collect())
        if not numbers:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        paths = [f"{self.path}/log/batch={n}" for n in numbers]
        read = self.spark.read.schema(LEDGER_SCHEMA).option("basePath", f"{self.path}/log").parquet(*paths)
        rows = read.select(*[F.col(c.split()[0]) for c in LEDGER_SCHEMA.split(", ")])
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    def events(self, run_id: str | None = None) -> DataFrame:
        """All committed events."""
        return self._log(-1, run_id)

    def _snapshot(self, run_id: str | None = None) -> DataFrame:
        """The last snapshot of each run; one folder per run."""
        kept = self._table("kept", KEPT_SCHEMA).groupBy("run_id").agg(F.max("upto").alias("upto"))
        kept = kept if run_id is None else kept.where(F.col("run_id") == run_id)
        runs: dict[int, list[str]] = {}
        for row in kept.collect():  # one row per run
            runs.setdefault(row["upto"], []).append(row["run_id"])
        if not runs:
            return self.spark.createDataFrame([], SNAPSHOT_SCHEMA)
        folders = [f"{self.path}/snapshot/upto={upto}" for upto in sorted(runs)]
        read = self.spark.read.schema(f"{SNAPSHOT_SCHEMA}, upto bigint").option("basePath", f"{self.path}/snapshot").parquet(*folders)
        wanted = F.lit(False)
        for upto, names in runs.items():
            wanted |= (F.col("upto") == upto) & F.col("run_id").isin(names)
        return read.where(wanted).select(*[F.col(c.split()[0]) for c in SNAPSHOT_SCHEMA.split(", ")])

    def compact(self) -> None:
        """Fold the tail into the snapshots of the runs that it holds."""
        upto, head = self._upto(), self._head()["batch"]
        if head <= upto:
            return
        tail = self._log(upto)
        runs = [r["run_id"] for r in tail.select("run_id").distinct().collect()]  # one row per run
        if not runs:
            return
        old = self._snapshot().where(F.col("run_id").isin(runs))
        # A row has few events, so that partials are dealt by row and sorted once, in tasks
        # of bounded size. Both counts come from what files say of themselves.
        rows = old.count() + tail.count()
        together = old.unionByName(as_partial(tail)).repartition(tasks_for(self.spark, rows), *ROW_KEY)
        merge_partials(together).select(*FOLDED, *MARKS).write.mode("overwrite").option("compression", "zstd").partitionBy("run_id").parquet(f"{self.path}/snapshot/upto={head}")
        self._commit(f"kept/upto={head}", [(run, head) for run in runs], KEPT_SCHEMA)

    def current(self, run_id: str | None = None) -> DataFrame:
        """The folded ledger: the snapshot alone if nothing came after it, else the
        snapshot and the tail folded once."""
        tail_from = self._upto()
        snapshot = self._snapshot(run_id)
        if self._head()["batch"] <= tail_from:
            return snapshot.select(*FOLDED)
        return merge_partials(snapshot.unionByName(as_partial(self._log(tail_from, run_id)))).select(*FOLDED)

    def settled(self, run_id: str | None = None) -> DataFrame:
        """The folded ledger as a plain table, for plans that read it more than once."""
        self.compact()
        return self._snapshot(run_id).select(*FOLDED)
