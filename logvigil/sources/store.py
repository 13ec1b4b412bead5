"""Finished runs as partitioned tables.

A run becomes visible by one row in ``run_log``, written after everything else, and disappears by
another before its files are removed, so readers never see a partial run and nothing is rewritten in place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.config import DEFAULT
from logvigil.plans.run import Run, STATS

RUN_STATS = "struct<" + ", ".join(f"{c}: bigint" for c in STATS) + ">"
LOG = f"analysis_id string, created_us bigint, source string, files bigint, stats {RUN_STATS}, has_ground_truth boolean, deleted boolean"
CHILDREN = ["files", "events", "alerts", "evidence", "incidents", "incident_entities", "entities", "story", "scenarios", "evaluation"]


def folder(root: str, name: str, analysis_id: str) -> str:
    """Folder of one table of one run. Ids become path names and later removals, so they are plain words."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", analysis_id):
        raise ValueError(f"not a run id: {analysis_id!r}")
    return f"{root}/{name}/analysis_id={analysis_id}"


def save(run: Run, root: str, analysis_id: str, source: str, created_us: int, keep: int = DEFAULT.max_runs) -> None:
    """Writes all tables of a run, its row in the run log last; then only the newest ``keep`` runs stay (all for 0)."""
    if source not in ("upload", "simulation"):
        raise ValueError(f"unknown source {source!r}")
    found = run.analysis
    tables = {"files": run.files, "events": found.events, "alerts": found.alerts, "evidence": found.evidence, "incidents": found.cards(),
              "incident_entities": found.incident_entities, "entities": found.entities, "story": found.story()}
    if run.evaluation is not None:
        tables |= {"scenarios": run.scenarios, "evaluation": run.evaluation}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(folder(root, name, analysis_id))
    spark = found.events.sparkSession
    log_rows(run.stats.select(
        F.lit(analysis_id).alias("analysis_id"), F.lit(created_us).cast("bigint").alias("created_us"), F.lit(source).alias("source"),
        run.files.agg(F.count("*")).scalar().alias("files"), F.struct(*STATS).alias("stats"),
        F.lit(run.evaluation is not None).alias("has_ground_truth"), F.lit(False).alias("deleted")), root)
    apply_retention(spark, root, keep)


def log_rows(rows: DataFrame, root: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{root}/run_log")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Visible runs, one row each; a run saved again counts as its latest row."""
    log = spark.read.schema(LOG).parquet(f"{root}/run_log")
    newest = log.groupBy("analysis_id").agg(F.max_by(F.struct(*log.columns), F.struct("created_us", "deleted")).alias("r")).select("r.*")
    return newest.filter("NOT deleted").drop("deleted")


def child(spark: SparkSession, root: str, name: str, analysis_id: str) -> DataFrame:
    """One table of a visible run; only its own files are listed."""
    path = folder(root, name, analysis_id)
    if runs(spark, root).filter(F.col("analysis_id") == analysis_id).isEmpty():
        raise LookupError(f"no run {analysis_id!r}")
    return spark.read.parquet(path).withColumn("analysis_id", F.lit(analysis_id))


def latest_runs(all_runs: DataFrame, limit: int = 100) -> DataFrame:
    """Run list, newest first (Q8)."""
    return all_runs.orderBy(F.desc("created_us"), "analysis_id").limit(limit)


def kept_runs(all_runs: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` runs, all of them for 0."""
    return all_runs.orderBy(F.desc("created_us"), "analysis_id").limit(keep) if keep else all_runs


def rows_of_runs(table: DataFrame, visible: DataFrame) -> DataFrame:
    """Child rows whose run still exists."""
    return table.join(visible.select("analysis_id").distinct(), "analysis_id", "left_semi")


def _remove(spark: SparkSession, root: str, gone: DataFrame) -> None:
    """Hides runs, then removes their files. The ids fetched are those of runs, never rows of tables."""
    ids = [r.analysis_id for r in gone.select("analysis_id").collect()]
    if not ids:
        return
    hidden = runs(spark, root).filter(F.col("analysis_id").isin(ids))
    log_rows(hidden.withColumn("deleted", F.lit(True)), root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for analysis_id in ids:
        for name in CHILDREN:
            path = hadoop(folder(root, name, analysis_id))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete(spark: SparkSession, root: str, analysis_id: str) -> bool:
    """Removes a run with everything that belongs to it; false where there is none."""
    gone = runs(spark, root).filter(F.col("analysis_id") == analysis_id)
    if gone.isEmpty():
        return False
    _remove(spark, root, gone)
    return True


def apply_retention(spark: SparkSession, root: str, keep: int) -> None:
    """Removes all but the newest ``keep`` runs."""
    if keep:
        visible = runs(spark, root)
        _remove(spark, root, visible.join(kept_runs(visible, keep).select("analysis_id"), "analysis_id", "left_anti"))
