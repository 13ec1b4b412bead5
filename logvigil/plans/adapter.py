"""Security events derived from the generic ``events`` table, and thresholds scaled to its density."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.config import DEFAULT, HOUR, MINUTE
from logvigil.functions.timing import micros

# The table holds a few rows per user and day, so the windows are hours instead of minutes.
SCALED = replace(
    DEFAULT, r1_threshold=5, r1_window=12 * HOUR, r2_distinct_users=3, r2_window=6 * HOUR, r3_threshold=6,
    r3_window=8 * HOUR, r3_typo_window=30 * MINUTE, r4_fail_threshold=3, r4_lookback=12 * HOUR,
    baseline_min_logins=3, r7_window=6 * HOUR, r9_threshold=5, r9_window=12 * HOUR, r11_window=12 * HOUR,
    r11_abs_bytes=40_000_000, correlation_window=1 * HOUR)

ATTACKS = [
    "/orders/list?sort=4%20UNION%20SELECT%20pin%20FROM%20staff", "/notes?title=%3Cscript%3Efetch(7)%3C/script%3E",
    "/reports/view?name=..%2F..%2F..%2Fvar%2Fbackup.tar", "/tools/lookup?zone=lan%3Bcat%20hosts.bak",
    "/stock?bin=9+UNION+SELECT+owner+FROM+lots", "/jump?to=javascript:prompt(3)",
]
PAGES = ["/start", "/team/contact", "/health?probe=2", "/broken?q=%qq+end", "/account"]
SCANNERS = ["sqlmap/1.8", "gobuster/3.6", "Nikto/2.5"]
BROWSERS = ["Mozilla/5.0", "curl/8.5", "Wget/1.21"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One security event per source row of the ``events`` table."""
    return security_events(table(spark, sf_dir, "events"))


def security_events(rows: DataFrame) -> DataFrame:
    """One security event per row: four users share an address, sixteen a /24.

    Every eighth address sends attack payloads, another eighth scans; one login in ten comes from elsewhere.
    """
    base = rows.select(
        "event_id", "user_id", "event_type", "value", micros("ts").alias("us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    typed = base.withColumn("type", F.expr("""
        CASE event_type WHEN 'error' THEN 'ssh_fail' WHEN 'signup' THEN 'ssh_success'
             WHEN 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'user_add' WHEN k % 10 = 1 THEN 'group_add' ELSE 'sudo' END
             ELSE 'http_request' END"""))
    grouped = typed.withColumn("g", F.expr("user_id div 4"))
    return grouped.select(
        F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("id"), "us",
        F.expr("CASE WHEN type = 'http_request' THEN 'web' ELSE 'auth' END").alias("source"), "type",
        F.expr("""CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND k = 97) THEN NULL
                       WHEN type = 'ssh_success' AND k % 10 = 5
                       THEN '10.200.' || (user_id div 256 % 256) || '.' || (user_id % 256)
                       ELSE '10.' || (g div 65536 % 256) || '.' || (g div 4 % 256) || '.' || (g % 4 + 1) END""").alias("src_ip"),
        F.expr("CASE WHEN type != 'http_request' THEN 'user' || user_id END").alias("user"),
        F.lit("host1").alias("host"),
        F.expr(f"""CASE WHEN type = 'http_request' THEN named_struct(
                'method', 'GET', 'path', CASE WHEN g % 8 = 3 AND k % 4 = 0 THEN {_sql_list(ATTACKS)}[k div 4 % {len(ATTACKS)}]
                             ELSE {_sql_list(PAGES)}[k % {len(PAGES)}] END,
                'status', CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END,
                'bytes', CAST(value * 100000 AS BIGINT), 'ua', CASE WHEN g % 8 = 5 AND k % 10 = 0 THEN {_sql_list(SCANNERS)}[k div 10 % {len(SCANNERS)}]
                           ELSE {_sql_list(BROWSERS)}[k % {len(BROWSERS)}] END) END
            """).alias("http"),
        F.lit("events").alias("file"), F.col("event_id").alias("line_no"),
        F.concat_ws(" ", F.lit("event"), F.col("event_id").cast("string"), "event_type").alias("raw"))
