"""Per-user login baseline and the hours it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.config import Thresholds
from logvigil.functions.timing import hour_of_day


def named_logins(events: DataFrame) -> DataFrame:
    return events.filter((F.col("type") == "ssh_success") & (F.coalesce(F.col("user"), F.lit("")) != ""))


def cutoff(events: DataFrame, cfg: Thresholds) -> Column:
    """End of the baseline period as a scalar subquery: Spark computes it once and ships one number."""
    span = F.max("us") - F.min("us")
    return named_logins(events).agg(
        (F.min("us") + F.bround(span * F.lit(cfg.baseline_fraction))).cast("bigint").alias("cutoff")).scalar()


def user_baseline(events: DataFrame, cfg: Thresholds) -> DataFrame:
    """``user, login_count, hours`` of the baseline period; hours is a set of at most 24."""
    return (named_logins(events).filter(F.col("us") <= cutoff(events, cfg))
            .groupBy("user").agg(F.count("*").alias("login_count"),
                                 F.array_sort(F.collect_set(hour_of_day(F.col("us")))).alias("hours")))


def known_addresses(events: DataFrame, cfg: Thresholds) -> DataFrame:
    """Distinct ``user, src_ip`` of the baseline period, kept long so membership is a join."""
    return (named_logins(events).filter((F.col("us") <= cutoff(events, cfg)) & F.col("src_ip").isNotNull())
            .select("user", "src_ip").distinct())


def normal_hours(hours: Column, cfg: Thresholds) -> Column:
    """Working hours plus the observed range widened by one hour on both sides, wrapping at midnight."""
    working = F.sequence(F.lit(cfg.work_start_hour).cast("bigint"), F.lit(cfg.work_end_hour - 1).cast("bigint"))
    around = F.transform(F.sequence(F.array_min(hours) - 1, F.array_max(hours) + 1), lambda h: F.pmod(h, F.lit(24)))
    return F.when(F.size(hours) > 0, F.array_union(working, around)).otherwise(working)


def judged_logins(events: DataFrame, cfg: Thresholds) -> DataFrame:
    """Logins after the baseline period by users with enough of it."""
    enough = user_baseline(events, cfg).filter(F.col("login_count") >= cfg.baseline_min_logins)
    return named_logins(events).filter(F.col("us") > cutoff(events, cfg)).join(enough, "user")
