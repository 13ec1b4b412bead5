"""Per-row work on the way from files to alerts: done once per row, and not at all where a line needs none."""

import random
import re

from helpers import events
from logvigil.functions.timing import iso
from logvigil.operators import rules
from logvigil.plans import samples
from logvigil.sources import text
from pyspark.sql import functions as F


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_ranged_before_they_become_lines(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 28:02d} 03:04:05.{i:06d}", i % 50, "error", 1.5, '{"k": 7}') for i in reversed(range(200))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.to_timestamp_ntz("ts")).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    written = samples.security_lines(spark, str(tmp_path))
    plan = optimized(written)
    # A plan lists later steps first.
    assert plan.index("StructsToJson") < plan.index("RepartitionByExpression")
    lines = [r.value for r in written.collect()]
    assert len(lines) == 216 and lines[0].startswith('{"ts":"2024-01-01T03:04:05Z"') and lines[1] == '{"broken": '
    assert [line[7:34] for line in lines if "broken" not in line] == [
        f'2024-01-{1 + i % 28:02d}T03:04:05' + (f".{i:06d}Z" if i else 'Z","even') for i in range(200)]


def test_paths_are_decoded_once(spark):
    found = rules.payload_hits(events(spark, [
        (i, "http_request", "192.0.2.1", None, ("GET", path, 200, 1, "b")) for i, path in enumerate(["/a?q=%3Cscript%3E", "/b", None, ""])]))
    assert optimized(found).count("UrlCodec") == 1
    assert [(r.decoded, r.label) for r in found.collect()] == [("/a?q=<script>", "XSS pattern")]


def test_plain_lines_need_no_cutting(spark):
    rng = random.Random(11)
    marks = ["a", "~", "!", " ", "\t", "\x0b", "\x1f", "\x00", "\x7f", "\x85", " ", "　", "é", "\\", "\r", ""]
    values = ["".join(rng.choice(marks) for _ in range(rng.randrange(9))) for _ in range(600)] + ["a b", " a", "a ", "", " "]
    got = text.cut_lines(spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, block long, value string").coalesce(1))
    assert optimized(got).count(text.PLAIN) == 1
    expected = [(i, part.replace("\x00", "").strip(text.SPACES)) for i, v in enumerate(values) for part in re.split(text.OTHER_BREAKS, v)]
    rows = got.orderBy("pos").collect()
    assert [(r.block, r.raw) for r in rows] == expected and [r.pos for r in rows] == list(range(len(rows)))


def test_iso_times(spark):
    times = {0: "1970-01-01T00:00:00Z", -1: "1969-12-31T23:59:59.999999Z", 1_700_000_000_000_050: "2023-11-14T22:13:20.000050Z", None: None}
    rows = spark.createDataFrame([(us,) for us in times], "us long").select("us", iso(F.col("us")).alias("t"), iso(F.col("us")).alias("u"))
    assert {r.us: r.t for r in rows.collect()} == times
    assert "format_string" not in optimized(rows)
