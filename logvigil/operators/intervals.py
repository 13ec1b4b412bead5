"""Time-interval operators that stay balanced when one key holds a large share of all rows.

Nothing here windows over the raw rows of a key. Rows are first reduced per (key, time cell), so
what is ordered within one key grows with the time span, not with the number of log lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.config import MINUTE
from logvigil.functions.timing import cell_of, floor_div
from logvigil.session import counted_small, settled

UNBOUNDED = Window.unboundedPreceding


def burst_cells(rows: DataFrame, key: str, width: int, threshold: int, distinct: str | None = None) -> DataFrame:
    """Threshold bursts (W1) as one row per (key, cell) taking part: ``key, cell, burst, burst_from``.

    A burst opens at the first row whose trailing ``width`` holds ``threshold`` rows (or distinct
    values of ``distinct``), starts at the first row within ``width`` of that trigger and lasts until
    a gap longer than ``width``. Cells are ``width`` long, which gives two exact reductions:
    the gap sessions follow from each cell's first and last instant alone, and the first trigger of a
    session is always among the first ``threshold`` rows (or values) of a cell, since a cell with that
    many has already triggered. Spark trims each map task to those rows before the shuffle.
    """
    if distinct is None:
        heads = "SELECT {key}, cell, us, row_number() OVER (PARTITION BY {key}, cell ORDER BY us) AS rank FROM r"
        reach = "us - lag(us, {n} - 1) OVER (PARTITION BY {key} ORDER BY us) <= {w}"
        pick = "us"
    else:
        # Of one value in one cell only its first and last row can matter to any trailing window.
        heads = ("SELECT *, row_number() OVER (PARTITION BY {key}, cell ORDER BY lo, value) AS rank FROM ("
                 "SELECT {key}, cell, {value} AS value, min(us) AS lo, max(us) AS hi FROM r GROUP BY {key}, cell, {value})")
        reach = ("size(collect_set(value) OVER (PARTITION BY {key} ORDER BY us "
                 "RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)) >= {n}")
        pick = "value, explode(array(lo, hi)) AS us"
    names = {"key": key, "n": threshold, "w": f"{width}L", "value": distinct}
    heads, reach = heads.format(**names), reach.format(**names)
    return rows.sparkSession.sql(f"""
        WITH r AS (SELECT *, {cell_of('us', width)} AS cell FROM {{rows}}),
        spans AS (SELECT {key}, cell, min(us) AS lo, max(us) AS hi FROM r GROUP BY {key}, cell),
        gaps AS (SELECT *, lo - lag(hi) OVER (PARTITION BY {key} ORDER BY cell) AS gap FROM spans),
        heads AS (SELECT {key}, cell, {pick} FROM ({heads}) WHERE rank <= {threshold}),
        triggers AS (SELECT {key}, cell, us FROM (SELECT *, {reach} AS fires FROM heads) WHERE fires),
        marks AS (
            SELECT {key}, cell, hi, CASE WHEN gap IS NULL OR gap > {width}L THEN lo END AS opens,
                   CAST(NULL AS BIGINT) AS fire_us FROM gaps
            UNION ALL SELECT {key}, cell, NULL, NULL, us FROM triggers),
        sessions AS (SELECT *, max(opens) OVER (PARTITION BY {key} ORDER BY cell) AS burst FROM marks),
        bursts AS (SELECT *, min(fire_us) OVER (PARTITION BY {key}, burst) - {width}L AS burst_from FROM sessions)
        SELECT {key}, cell, burst, burst_from FROM bursts WHERE hi >= burst_from""", rows=rows)


def burst_rows(rows: DataFrame, key: str, width: int, threshold: int, distinct: str | None = None) -> DataFrame:
    """The rows inside bursts with their ``burst`` id.

    Cells are written once, for all that look at the rows later, and come to the rows within a counted bound. Beyond that both sides are
    shuffled; the cell side is unique, so AQE can split a hot cell.
    """
    cells = counted_small(settled(burst_cells(rows, key, width, threshold, distinct), "burst-cells"))
    return (rows.withColumn("cell", floor_div(F.col("us"), width)).join(cells, [key, "cell"])
            .filter(F.col("us") >= F.col("burst_from")).drop("cell", "burst_from"))


def trailing_stats(points: DataFrame, probes: DataFrame, keys: Sequence[str], width: int,
                   stats: dict[str, tuple[str, str]]) -> DataFrame:
    """For each distinct probe instant, statistics of the points in ``[us - width, us]`` of the same keys.

    An interval join without pairs: with cells exactly ``width`` long, every interval is a suffix of
    one cell plus a prefix of the next. Two running aggregates per (keys, cell) answer all probes, and
    points are reduced to one row per instant first. ``stats`` maps a name to (sum|min|max, SQL over
    ``points``). Returns ``keys, us, *stats``; probes with nothing in range have nulls.
    """
    on = "".join(f"{k}, " for k in keys)
    values = ", ".join(f"{sql} AS {name}" for name, (_, sql) in stats.items())
    nulls = ", ".join("NULL" for _ in stats)
    ticks = ", ".join(f"{fold}({name}) AS {name}" for name, (fold, _) in stats.items())
    spread = ", ".join(f"CASE WHEN mark = 1 THEN {name} END AS {name}" for name in stats)
    upto = f"(PARTITION BY {on}cell ORDER BY at, mark ROWS UNBOUNDED PRECEDING)"
    onward = f"(PARTITION BY {on}cell ORDER BY at DESC, mark DESC ROWS UNBOUNDED PRECEDING)"
    sides = ", ".join(f"CASE WHEN mark = 1 THEN {fold}({name}) OVER {upto} ELSE {fold}({name}) OVER {onward} END AS {name}"
                      for name, (fold, _) in stats.items())
    return points.sparkSession.sql(f"""
        WITH ticks AS (
            SELECT {on}us, max(probe) AS probe, {ticks} FROM (
                SELECT {on}us, false AS probe, {values} FROM {{points}}
                UNION ALL SELECT {on}us, true, {nulls} FROM {{probes}}) GROUP BY {on}us),
        marks AS (
            SELECT {on}{cell_of('us', width)} - (1 - mark) AS cell, us - (1 - mark) * {width}L AS at, mark,
                   CASE WHEN probe THEN us END AS us, {spread}
            FROM ticks LATERAL VIEW explode(CASE WHEN probe THEN array(1, 0) ELSE array(1) END) AS mark),
        found AS (SELECT {on}us, {sides} FROM marks)
        SELECT {on}us, {ticks} FROM found WHERE us IS NOT NULL GROUP BY {on}us""", points=points, probes=probes)


def pair_in_range(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Points with the spans ``[span_from, span_to]`` that hold them, joined on (keys, cell of ``width``)."""
    on = ", ".join([*keys, "cell"])
    return points.sparkSession.sql(f"""
        SELECT * EXCEPT (cell) FROM (SELECT *, {cell_of('us', width)} AS cell FROM {{points}})
        JOIN (SELECT *, explode(sequence({cell_of('span_from', width)}, {cell_of('span_to', width)})) AS cell FROM {{spans}})
        USING ({on}) WHERE us BETWEEN span_from AND span_to""", points=points, spans=spans)


def span_ends(points: DataFrame, spans: DataFrame, key: str, name: str, head: int, tail: int) -> DataFrame:
    """The first ``head`` and the last ``tail`` points in time order of each span of ``span_from, n``, without the points between.

    A span starts at an instant of some point of its key and holds the ``n`` points from there on. Points are numbered once per key,
    so a span is a range of numbers and takes at most ``head + tail`` rows, however many points overlapping spans share.
    """
    order = ["us", "file", "line_no"]
    rows = points.filter("us IS NOT NULL").withColumn("chunk", floor_div(F.col("us"), MINUTE)).withColumn("one", F.lit(1).cast("bigint"))
    ranked = settled(with_running_sum(rows, [key], "chunk", order, "one", "rank").drop("chunk", "one"), name)
    starts = ranked.groupBy(key, F.col("us").alias("span_from")).agg(F.min("rank").alias("lowest"))
    places = F.expr(f"""CASE WHEN n <= {head + tail} THEN sequence(0L, n - 1)
        ELSE concat(sequence(0L, {head - 1}L), sequence(n - {tail}, n - 1)) END""")
    wanted = (spans.filter("n > 0").join(starts, [key, "span_from"])
              .withColumn("rank", F.explode(F.transform(places, lambda i: F.col("lowest") + i))).drop("lowest", "n", "span_from"))
    return wanted.join(ranked, [key, "rank"]).drop("rank")


def with_previous(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str,
                  name: str) -> DataFrame:
    """The last non-null ``value`` before each row per keys, found per (keys, chunk) with a carried tail.

    ``chunk`` must grow with ``order``. Only one row per chunk is ever ordered within a whole key.
    """
    keys = list(keys)
    before_row = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(UNBOUNDED, -1)
    before_chunk = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(UNBOUNDED, -1)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    tails = (rows.groupBy(*keys, chunk).agg(F.max_by(value, place).alias("tail"))
             .withColumn("carried", F.last("tail", ignorenulls=True).over(before_chunk)).drop("tail"))
    return (rows.withColumn("local", F.last(value, ignorenulls=True).over(before_row)).join(tails, [*keys, chunk])
            .withColumn(name, F.coalesce("local", "carried")).drop("local", "carried"))


def with_running_sum(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str,
                     name: str) -> DataFrame:
    """Running sum per keys up to the row itself: a sum within the chunk plus the total of the chunks before."""
    keys = list(keys)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    local = F.coalesce(F.sum(value).over(in_chunk), F.lit(0).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(UNBOUNDED, -1)
    totals = (rows.groupBy(*keys, chunk).agg(F.sum(value).alias("total"))
              .withColumn("carry", F.coalesce(F.sum("total").over(before), F.lit(0).cast("bigint"))).drop("total"))
    return (rows.withColumn("local", local).join(totals, [*keys, chunk])
            .withColumn(name, (F.col("local") + F.col("carry")).cast("bigint")).drop("local", "carry"))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based rank over the whole frame without one global sort task.

    ``order`` must tell all rows apart. Ranges of it are cut by sampling, whatever the values, so no busy hour and no frequent
    score fills a task; they are written in their order with a place that grows by one inside a range, which the counts of the ranges
    before turn into the rank. Rows are moved once, and the result is read from what was written.
    """
    ranges = rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged = settled(ranges.withColumn("place", F.monotonically_increasing_id()), f"{name}-ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("range_no").rowsBetween(UNBOUNDED, -1)  # one row per range
    offset = F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")) + 1 - F.col("first")
    counts = ranged.groupBy("range_no").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    offsets = counted_small(settled(counts.select("range_no", offset.alias("offset")), f"{name}-offsets"))
    return ranged.join(offsets, "range_no").withColumn(name, F.col("place") + F.col("offset")).drop("place", "offset", "range_no")


def dyadic_cover(first: str, last: str, top: int) -> str:
    """SQL for the aligned blocks of 1, 2, 4, ... cells that make up cells ``first`` to ``last``: at most two of each size.

    ``top`` is the exponent of the largest block that fits the longest range.
    """
    steps = (f"filter(transform(sequence(0, {top}), k -> named_struct('level', k, 'l', -shiftright(-({first}), k), 'r', shiftright({last} + 1, k))), "
             "s -> s.l < s.r)")
    ends = ("array(named_struct('level', s.level, 'node', CASE WHEN s.l & 1 = 1 THEN s.l END), "
            "named_struct('level', s.level, 'node', CASE WHEN s.r & 1 = 1 THEN s.r - 1 END))")
    return f"filter(flatten(transform({steps}, s -> {ends})), n -> n.node IS NOT NULL)"


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of equal keys whose ``[left_from, left_to]`` and ``[right_from, right_to]`` share an instant, each pair once.

    Two ranges overlap where one starts inside the other. A range is dealt over its dyadic cover and a start over the blocks
    that hold it, so both take a number of rows logarithmic in the longest range, and a start meets a range in one block only.
    Both sides are read several times: pass written tables.
    """
    def cells(side: str) -> str:
        return f"{cell_of(f'{side}_to', width)} - {cell_of(f'{side}_from', width)}"

    longest = max(rows.agg(F.max(F.expr(cells(side)))).first()[0] or 0 for rows, side in ((left, "left"), (right, "right")))
    top = (longest + 1).bit_length() - 1
    on = ", ".join([*keys, "level", "node"])

    def starts(of: str) -> str:
        return (f"(SELECT *, shiftright({cell_of(f'{of}_from', width)}, level) AS node FROM "
                f"(SELECT *, explode(sequence(0, {top})) AS level FROM {{{of}}}))")

    def ranges(of: str) -> str:
        cover = dyadic_cover(cell_of(f"{of}_from", width), cell_of(f"{of}_to", width), top)
        return f"(SELECT * EXCEPT (block), block.level AS level, block.node AS node FROM (SELECT *, explode({cover}) AS block FROM {{{of}}}))"

    return left.sparkSession.sql(f"""
        SELECT * EXCEPT (level, node) FROM {starts('left')} JOIN {ranges('right')} USING ({on}) WHERE left_from BETWEEN right_from AND right_to
        UNION ALL
        SELECT * EXCEPT (level, node) FROM {ranges('left')} JOIN {starts('right')} USING ({on}) WHERE right_from > left_from AND right_from <= left_to
        """, left=left, right=right)
