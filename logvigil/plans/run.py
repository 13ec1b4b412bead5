"""One run from log files to result: quarantine, names, events, analysis, totals and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.config import DEFAULT, Thresholds
from logvigil.operators import evaluate
from logvigil.plans.analysis import Analysis, analyse
from logvigil.session import settled
from logvigil.sources import formats

STATS = ["lines_total", "parsed", "skipped", "events", "alerts", "incidents"]


@dataclass
class Run:
    """``files`` has one row per file with its counts and what is wrong with it, ``stats`` one row of six totals."""

    files: DataFrame
    analysis: Analysis
    stats: DataFrame
    evaluation: DataFrame | None = None
    scenarios: DataFrame | None = None


def totals(files: DataFrame, analysis: Analysis) -> DataFrame:
    """One row: lines in all, parsed and skipped, events, alerts, incidents."""
    lines = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in STATS[:4]])
    return lines.select(*STATS[:4], analysis.alerts.agg(F.count("*")).scalar().alias("alerts"),
                        analysis.incidents.agg(F.count("*")).scalar().alias("incidents"))


def run(spark: SparkSession, paths: list[str], cfg: Thresholds = DEFAULT, labels: DataFrame | None = None,
        clean_incidents: DataFrame | None = None) -> Run:
    """Analyses files, and scores the result where ground truth is given.

    ``clean_incidents`` are those of a run over traffic without attacks; its critical ones are then the false alarms.
    """
    files = settled(formats.known_files(spark, paths), "files")
    parsed = settled(formats.ingest(spark, paths, cfg, files), "parsed")
    report = settled(formats.file_report(files, parsed), "file-report")
    formats.require_parsed(report)
    found = analyse(formats.events_of(parsed), cfg)
    out = Run(report, found, settled(totals(report, found), "stats"))
    if labels is not None:
        out.scenarios = settled(evaluate.scenario_matches(
            found.incidents, found.incident_entities, evaluate.scenario_values(labels), cfg, evaluate.scenario_stages(labels)), "scenarios")
        out.evaluation = settled(evaluate.evaluation(
            found.incidents, found.incident_entities, evaluate.malicious_values(labels), out.scenarios, cfg, clean_incidents), "evaluation")
    return out
