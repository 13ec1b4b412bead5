"""Risk scores of groups of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.config import Thresholds
from logvigil.functions.text import chain_multiplier, risk_level


def risk_score(points: Column, stages: Column) -> Column:
    return F.least(F.lit(100).cast("bigint"), F.bround(points * chain_multiplier(stages)).cast("bigint"))


def scored(alerts: DataFrame, keys: list[str], cfg: Thresholds, *per_rule: Column, final: list[Column] = ()) -> DataFrame:
    """``keys, risk_score, level, alert_count, first_us, last_us``: each rule counts at most ``rule_repeat_cap`` times.

    Alerts are first counted per (keys, rule), so a key with very many alerts shrinks before the second
    step. ``per_rule`` and ``final`` add further aggregates at the two levels.
    """
    by_rule = alerts.groupBy(*keys, "rule_id", "stage", "points").agg(
        F.count("*").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *per_rule)
    capped = F.col("points") * F.least(F.col("n"), F.lit(cfg.rule_repeat_cap).cast("bigint"))
    return (by_rule.groupBy(*keys).agg(
        F.sum(capped).alias("points"), F.size(F.collect_set("stage")).alias("n_stages"),
        F.sum("n").alias("alert_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *final)
        .withColumn("risk_score", risk_score(F.col("points"), F.col("n_stages")))
        .withColumn("level", risk_level(F.col("risk_score"))).drop("points", "n_stages"))


def entity_rows(alerts: DataFrame) -> DataFrame:
    """One row per alert and entity it names: ``type`` (ip or user) and ``value``."""
    pair = F.array(F.struct(F.lit("ip").alias("type"), F.col("src_ip").alias("value")),
                   F.struct(F.lit("user").alias("type"), F.col("user").alias("value")))
    return (alerts.withColumn("entity", F.explode(pair)).select("*", "entity.*").drop("entity")
            .filter("coalesce(value, '') != ''"))


def score_entities(alerts: DataFrame, cfg: Thresholds) -> DataFrame:
    return scored(entity_rows(alerts), ["type", "value"], cfg)
