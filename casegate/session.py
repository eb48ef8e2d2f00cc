"""Session set-up and the two helpers every job shares: where intermediate
tables may be written, and whether a side is small enough to broadcast."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000
# Rows that one task of a shuffle sorts, where their number is known.
TASK_ROWS = 500_000

_local_workspaces: dict[str, str] = {}

T = TypeVar("T")


def local_session(app: str = "casegate", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark. Clusters bring their own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call sites of every column cost more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession) -> str:
    """Folder for tables that cut lineage. It is the shared folder the cluster
    names in ``spark.checkpoint.dir``; only a local session may go without."""
    app = spark.sparkContext.applicationId
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return f"{shared.rstrip('/')}/casegate/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_workspaces:
        folder = tempfile.mkdtemp(prefix="casegate-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_workspaces[app] = folder
    return _local_workspaces[app]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting at most ``rows + 1`` rows; a larger side
    keeps its plan and is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks that take at most about ``each`` rows, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def materialised(df: DataFrame) -> DataFrame:
    """Write a table to the workspace and read it back: computed once, and never taken
    from what an earlier frame left in memory. It costs one copy of the rows there, also
    of an export's lines, which stays until the workspace is cleared."""
    path = f"{workspace(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator instead of a projection.

    A filter above a projection is pushed below it by copying the expressions it
    needs. Readings that build on readings would be copied many times over; a
    generator's output is computed once per row and never copied.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def per_session(build: Callable[..., T]) -> Callable[..., T]:
    """Build expressions once per application. They are immutable, and each node
    of one costs a round trip to the JVM."""
    kept: dict[tuple, T] = {}

    @functools.wraps(build)
    def cached(*args: object) -> T:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached
