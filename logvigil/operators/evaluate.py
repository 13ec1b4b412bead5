"""Scores an analysis against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.config import Thresholds

LABELS = ("malicious_ips array<string>, malicious_users array<string>, "
          "scenarios map<string, struct<ips: array<string>, users: array<string>, stages: array<string>>>")
LEVELS = ["critical", "high", "medium", "low"]


def load_labels(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Ground truth from one JSON document, or from one JSON object per line where it is large."""
    return spark.read.schema(LABELS).json(path, multiLine=one_document)


def malicious_values(labels: DataFrame) -> DataFrame:
    """Distinct malicious ``value``; addresses and users are one set."""
    both = F.concat(F.coalesce("malicious_ips", F.array().cast("array<string>")),
                    F.coalesce("malicious_users", F.array().cast("array<string>")))
    return labels.select(F.explode(both).alias("value")).distinct()


def scenario_values(labels: DataFrame) -> DataFrame:
    """Distinct ``scenario_id, value`` expected per scenario; a scenario that names no entity has one row with a null value."""
    none = F.array().cast("array<string>")
    return (labels.select(F.explode("scenarios").alias("scenario_id", "s"))
            .select("scenario_id", F.explode_outer(F.concat(F.coalesce("s.ips", none), F.coalesce("s.users", none))).alias("value"))
            .distinct())


def scenario_stages(labels: DataFrame) -> DataFrame:
    """``scenario_id, expected_stages``: each stage once, in the order given."""
    stages = (labels.select(F.explode("scenarios").alias("scenario_id", "s"))
              .select("scenario_id", F.posexplode("s.stages").alias("place", "stage"))
              .groupBy("scenario_id", "stage").agg(F.min("place").alias("place")))
    return stages.groupBy("scenario_id").agg(F.expr("array_sort(collect_list(struct(place, stage))).stage").alias("expected_stages"))


def entity_quality(incidents: DataFrame, entities: DataFrame, malicious: DataFrame, cfg: Thresholds) -> DataFrame:
    """One row ``tp, fp, fn, precision, recall`` over the entities of reported incidents (V1)."""
    reported = incidents.filter(F.col("risk_score") >= cfg.evaluation_min_risk).select("incident_id")
    flagged = (entities.join(reported, "incident_id", "left_semi").select("value").distinct()
               .withColumn("flagged", F.lit(True)))
    both = flagged.join(malicious.withColumn("bad", F.lit(True)), "value", "full_outer")
    return both.agg(F.count(F.expr("CASE WHEN flagged AND bad THEN 1 END")).alias("tp"),
                    F.count(F.expr("CASE WHEN flagged AND bad IS NULL THEN 1 END")).alias("fp"),
                    F.count(F.expr("CASE WHEN bad AND flagged IS NULL THEN 1 END")).alias("fn")).selectExpr(
        "tp", "fp", "fn",
        "CASE WHEN tp + fp > 0 THEN bround(tp / (tp + fp), 3) WHEN tp + fn = 0 THEN 1.0D ELSE 0.0D END AS precision",
        "CASE WHEN tp + fn > 0 THEN bround(tp / (tp + fn), 3) ELSE 1.0D END AS recall")


def scenario_matches(incidents: DataFrame, entities: DataFrame, expected: DataFrame, cfg: Thresholds, stages: DataFrame) -> DataFrame:
    """Per scenario the reported incident sharing most entities, the first in rank on ties (V2).

    ``expected`` are the entities of ``scenario_values``, ``stages`` those of ``scenario_stages``.
    """
    reported = incidents.filter(F.col("risk_score") >= cfg.evaluation_min_risk).select("incident_id", "incident_no", "stages")
    shared = (expected.join(entities.select("incident_id", "value").distinct(), "value").join(reported, "incident_id")
              .groupBy("scenario_id", "incident_id", "incident_no", "stages")
              .agg(F.count("*").alias("overlap"), F.array_sort(F.collect_list("value")).alias("found_entities")))
    best = (shared.groupBy("scenario_id").agg(F.max_by(
        F.struct("incident_id", "found_entities", "stages"), F.struct("overlap", -F.col("incident_no"))).alias("best")))
    listed = expected.groupBy("scenario_id").agg(F.array_sort(F.collect_list("value")).alias("expected_entities"))
    none = F.array().cast("array<string>")
    return listed.join(best, "scenario_id", "left").join(stages, "scenario_id", "left").select(
        "scenario_id", F.col("best").isNotNull().alias("detected"), "expected_entities",
        F.coalesce("best.found_entities", none).alias("found_entities"), F.col("best.incident_id").alias("incident_id"),
        F.coalesce("expected_stages", none).alias("expected_stages"), F.coalesce("best.stages", none).alias("found_stages"))


def level_counts(incidents: DataFrame) -> DataFrame:
    """One row with the number of incidents per level, zero where there are none."""
    return incidents.agg(F.count("*").alias("incidents"),
                         *[F.count(F.when(F.col("level") == level, 1)).alias(level) for level in LEVELS])


def critical_false_positives(incidents: DataFrame, entities: DataFrame, malicious: DataFrame,
                             clean_incidents: DataFrame | None = None) -> DataFrame:
    """One row: critical incidents without a malicious entity, and the figure to report (V3).

    With a run over clean data its critical incidents are reported, else those of this run.
    """
    caught = entities.join(malicious, "value", "left_semi").select("incident_id").distinct()
    in_run = (incidents.filter("level = 'critical'").join(caught, "incident_id", "left_anti")
              .agg(F.count("*").alias("critical_false_positives_in_attack_run")))
    if clean_incidents is None:
        return in_run.select(F.col("critical_false_positives_in_attack_run").alias("critical_false_positives"),
                             F.lit("attack_run").alias("source"), "critical_false_positives_in_attack_run")
    clean = level_counts(clean_incidents).select("critical").scalar()
    return in_run.select(clean.alias("critical_false_positives"), F.lit("baseline_only").alias("source"),
                         "critical_false_positives_in_attack_run")


def evaluation(incidents: DataFrame, entities: DataFrame, malicious: DataFrame, scenarios: DataFrame, cfg: Thresholds,
               clean_incidents: DataFrame | None = None) -> DataFrame:
    """One row with the scenarios found and in all, precision and recall, false alarms, and level counts of clean data (null without)."""
    found = scenarios.agg(F.count(F.when(F.col("detected"), 1)).alias("scenarios_detected"), F.count("*").alias("scenarios_total"))
    quality = entity_quality(incidents, entities, malicious, cfg).select(F.struct("precision", "recall")).scalar()
    alarms = critical_false_positives(incidents, entities, malicious, clean_incidents)
    names = alarms.columns
    shape = "struct<" + ",".join(f"{c}:bigint" for c in ["incidents", *LEVELS]) + ">"
    clean = (F.lit(None).cast(shape) if clean_incidents is None else
             level_counts(clean_incidents).select(F.struct("incidents", *LEVELS)).scalar())
    return (found.withColumn("quality", quality).withColumn("alarms", alarms.select(F.struct(*names)).scalar()).withColumn("clean_data", clean)
            .select("scenarios_detected", "scenarios_total", "quality.*", "alarms.*", "clean_data"))
