"""Detection thresholds. One frozen object is passed to every operator, so a query can override any of them."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


@dataclass(frozen=True)
class Thresholds:
    """All windows are in microseconds; the defaults are the fixed values results must agree with."""

    r1_threshold: int = 10
    r1_window: int = 5 * MINUTE
    r2_distinct_users: int = 5
    r2_window: int = 10 * MINUTE
    r3_threshold: int = 15
    r3_window: int = 6 * HOUR
    r3_typo_window: int = 5 * MINUTE
    r4_fail_threshold: int = 5
    r4_lookback: int = 60 * MINUTE
    work_start_hour: int = 8
    work_end_hour: int = 20
    r7_window: int = 60 * MINUTE
    r9_threshold: int = 30
    r9_window: int = 5 * MINUTE
    r11_window: int = 10 * MINUTE
    r11_abs_bytes: int = 52_428_800
    r11_median_multiplier: int = 20
    r11_min_bytes: int = 5_242_880
    baseline_min_logins: int = 5
    baseline_fraction: float = 0.25
    rule_repeat_cap: int = 2
    correlation_window: int = 2 * HOUR
    evaluation_min_risk: int = 30
    default_year: int = 2026
    auth_utc_offset_minutes: int = 0
    max_runs: int = 50


DEFAULT = Thresholds()
