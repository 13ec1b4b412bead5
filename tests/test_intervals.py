"""Interval operators against direct definitions on random data with ties."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import MINUTE, SECOND, bursts, events, transfers
from logvigil import session
from logvigil.config import DEFAULT
from logvigil.operators import intervals, rules
from logvigil.operators.intervals import burst_rows, dyadic_cover, numbered, overlapping, trailing_stats, with_previous, with_running_sum
from logvigil.operators.ranks import exact_median


def by_key(rows, key):
    out = {}
    for row in rows:
        out.setdefault(key(row), []).append(row)
    return out


@pytest.mark.parametrize("seed,distinct", [(1, None), (2, None), (3, "user"), (4, "user")])
def test_bursts_equal_a_walk_over_each_key(spark, seed, distinct):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(-20, 400) * 7 * SECOND, f"k{rng.choice([0, 0, 0, 1, 2])}", f"u{rng.randrange(6)}") for _ in range(400))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, us bigint, key string, user string")
    window, threshold = 60 * SECOND, 4
    got = {r.i: (r.key, r.burst) for r in burst_rows(df, "key", window, threshold, distinct).collect()}
    expected = set()
    for key, own in by_key(list(enumerate(rows)), lambda r: r[1][1]).items():
        found = bursts([r[1][0] for r in own], window, threshold, [r[1][2] for r in own] if distinct else None)
        for part in found:
            members = frozenset(own[i][0] for i in part)
            expected.add((key, members))
    groups = by_key(got.items(), lambda kv: kv[1])
    assert {(key, frozenset(i for i, _ in members)) for (key, _), members in groups.items()} == expected
    assert expected


def test_trailing_stats_equal_all_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.randrange(-50, 300), rng.randrange(100)) for _ in range(200)]
    probes = [(rng.choice("abc"), rng.randrange(-50, 300)) for _ in range(100)]
    got = trailing_stats(spark.createDataFrame(points, "k string, us bigint, v bigint"), spark.createDataFrame(probes, "k string, us bigint"),
                         ["k"], 30, {"n": ("sum", "1L"), "first": ("min", "struct(us, v)"), "top": ("max", "v")})
    for row in got.collect():
        near = sorted((us, v) for k, us, v in points if k == row.k and row.us - 30 <= us <= row.us)
        assert (row.n or 0) == len(near)
        assert (tuple(row.first) if row.first else None) == (near[0] if near else None)
        assert row.top == max((v for _, v in near), default=None)
    assert got.count() == len(set(probes))


def test_carried_lag_and_sum_do_not_depend_on_chunks(spark):
    rng = random.Random(6)
    rows = [(f, n, rng.choice([None, 1, 2, 3])) for f in "xy" for n in range(200)]
    df = spark.createDataFrame(rows, "f string, n bigint, v bigint").withColumn("chunk", F.expr("n div 7"))
    got = with_previous(df, ["f"], "chunk", ["n"], "v", "before")
    got = with_running_sum(got, ["f"], "chunk", ["n"], "v", "total")
    for f, own in by_key(((r.f, r.n, r.v, r.before, r.total) for r in got.collect()), lambda r: r[0]).items():
        last, total = None, 0
        for _, _, v, before, running in sorted(own, key=lambda r: r[1]):
            total += v or 0
            assert before == last and (running or 0) == total
            last = v if v is not None else last


def test_rows_stay_where_they_are_to_find_their_burst(spark):
    """The cells of bursts are written and counted; only where they are too many do rows move."""
    df = spark.range(300).selectExpr("'k' || id % 3 AS k", f"id * {MINUTE} AS us", "id")
    plan = intervals.burst_rows(df, "k", 30 * MINUTE, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_numbering_moves_rows_once(spark):
    """The result is what was written in ranges: only the counts of the ranges come to it."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit("wide").alias("text")).repartition(5)
    ranked = numbered(df, ["v"], "no")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert [r.no for r in ranked.orderBy("v").collect()] == list(range(1, 1001)) and ranked.columns == ["v", "text", "no"]


def test_numbering_is_a_global_order(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 7919) % 503)
    rows = numbered(df, ["v"], "no").orderBy("v").collect()
    assert [r.no for r in rows] == list(range(1, 501))


def test_rows_of_one_hour_are_numbered_by_many_tasks(spark, monkeypatch):
    ranges = []
    monkeypatch.setattr(intervals, "settled", lambda df, name: ranges.append(session.settled(df, name)) or ranges[-1])
    df = spark.range(4000).selectExpr("5 AS us", "id * 7919 % 4001 AS tie", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = numbered(df.repartition(4), [F.desc("us"), "tie"], "no").orderBy("no").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.no for r in rows] == list(range(1, 4001)) and [r.tie for r in rows] == sorted(r.tie for r in rows)
    counts = [r["count"] for r in ranges[0].groupBy("range_no").count().collect()]
    assert len(counts) == 4 and max(counts) < 2000


@pytest.mark.parametrize("longest", [0, 7, 40, 100_000])
def test_overlaps_equal_all_pairs(spark, longest):
    rng = random.Random(longest)

    def side(n):
        out = []
        for i in range(n):
            start = rng.randrange(-300, 300) * rng.choice([1, 1, 10])
            out.append((rng.choice(["a", "b"]), i, start, start + rng.randrange(longest + 1)))
        return out

    left, right = side(60), side(50)
    frames = [spark.createDataFrame(rows, f"k string, {name} int, {name}_from bigint, {name}_to bigint") for name, rows in (("left", left), ("right", right))]
    got = sorted((r.left, r.right) for r in overlapping(*frames, ["k"], 10).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])


def test_long_ranges_take_few_rows(spark):
    few = spark.sql(f"SELECT size({dyadic_cover('a', 'b', 20)}) AS n FROM VALUES (3L, 1000000L), (-5L, -5L), (0L, 0L) AS t(a, b)").collect()
    assert few[0].n <= 40 and few[1].n == few[2].n == 1


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 9], [0, 70_000, 5_000_000_000, 7, 1 << 40], list(range(1000))])
def test_exact_median(spark, values):
    ordered, n = sorted(values), len(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert exact_median(df, "v") == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@pytest.mark.parametrize("seed, pause", [(1, 3), (2, 9), (3, 40)])
def test_separated_instants(spark, seed, pause):
    """Chains of many links, pauses, and a key with nearly all instants, without a group in Python."""
    rng, rows = random.Random(seed), set()
    for key, n in (("hot", 900), ("b", 20), ("c", 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 2, 3, pause, 10, 11])
            rows.add((key, at))
    got = rules.separated(spark.createDataFrame(sorted(rows), "k string, us bigint"), "k", 10)
    expected = set()
    for key in {k for k, _ in rows}:
        rest = sorted(us for k, us in rows if k == key)
        while rest:
            expected.add((key, rest[0]))
            rest = [us for us in rest if us > rest[0] + 10]
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_transfers_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    cfg = replace(DEFAULT, r11_window=60 * SECOND, r11_abs_bytes=1000, r11_min_bytes=100)
    rows = sorted((rng.randrange(0, 900) * 3 * SECOND, f"10.0.0.{rng.choice([1, 1, 1, 2])}", rng.choice([10, 80, 300, 700, 1500])) for _ in range(300))
    ev = events(spark, [(us, "http_request", ip, None, ("GET", "/", 200, size, "x")) for us, ip, size in rows])
    found = rules.r11_large_transfer(ev, cfg)
    got = {(r.src_ip, r.first_id, r["count"]) for r in found.alerts.collect()}
    _, limit = rules.transfer_threshold(rules.transfers(ev), cfg)
    expected = set()
    for ip, own in by_key([(f"f:{n}", *r) for n, r in enumerate(rows, start=1)], lambda r: r[2]).items():
        for part in transfers([(r[1], r[3]) for r in own], cfg.r11_window, limit):
            expected.add((ip, own[part[0]][0], len(part)))
    assert got == expected and expected
    assert found.evidence.count() == sum(n for _, _, n in expected)


def test_one_hot_key_is_cut_into_cells(spark):
    """A key holding nearly all rows never reaches a window as raw rows: only cells and the first few rows of each."""
    n = 20_000
    hot = spark.range(n).select(F.lit("hot").alias("key"), (F.col("id") * 1000).alias("us"))
    rows = burst_rows(hot, "key", MINUTE, 10)
    assert rows.count() == n and rows.select("burst").distinct().count() == 1
    assert "WindowGroupLimit" in rows._jdf.queryExecution().toString()
