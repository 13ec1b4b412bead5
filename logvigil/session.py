"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "logvigil", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are planned for. Sizes stay the cluster's own choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master where none is configured (tests)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None or not current.startswith(configured.rstrip("/")):
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logvigil-checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame, name: str, *partition_by: str, reader: SparkSession | None = None) -> DataFrame:
    """Writes a frame that several later steps read to the shared folder and reads it back, in another session if one is given.

    The table survives executor loss, is computed once and is pruned by column on every later read.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/logvigil/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path).select(*df.columns)


#: Rows of a few hundred bytes that are sent to every task at most; larger tables are joined by shuffles.
SMALL_ROWS = 100_000


def counted_small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its counted rows are within the limit."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def settled_with(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """Like ``settled``, with aggregates over the written rows that cost no pass of their own."""
    observed = Observation(name)
    table = settled(df.observe(observed, *metrics), name)
    return table, observed.get


def side_by_side(*jobs: Callable, at_once: int | None = None):
    """Results of independent Spark jobs submitted together, so that short stages overlap; their threads carry the caller's job group."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    with ThreadPoolExecutor(at_once or len(jobs)) as pool:
        return [future.result() for future in [pool.submit(inherit(job)) for job in jobs]]
