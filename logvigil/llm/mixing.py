"""Mixing sources to target weights: pivotal dependent rounding of copy numbers through a reduction tree."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.session import settled, settled_with

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
FAN_IN = 32


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size, weight and target.

    Targets share the total by weight; none exceeds ``most`` times its source, and the excess goes to the others by
    weight until none is above. In the order of most * size / weight, the capped sources are a prefix, so
    the fixpoint follows from running sums: the first source whose share of what is left fits its cap ends the prefix.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(everything) - F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    share = weighed.withColumns({
        "_left": F.coalesce(left, F.sum("source_size").over(everything)).cast("double"), "_weights": F.sum("weight").over(rest),
        "_rank": F.row_number().over(by_level)})
    fits = F.col("_left") * F.col("weight") / F.col("_weights") <= cap
    # The last source always fits: what is left for it is at most what it may hold, as all caps sum to `most` totals.
    share = share.withColumn("_free", F.min(F.when(fits, F.struct("_rank", "_left", "_weights"))).over(everything))
    target = F.when(F.col("_rank") < F.col("_free._rank"), cap.cast("double")).otherwise(
        F.col("_free._left") * F.col("weight") / F.col("_free._weights"))
    return share.select("source", "source_size", "weight", F.coalesce(target, cap.cast("double")).alias("target"))


def _unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _play(held: Column, row: Column, level: int, seed: int) -> Column:
    """One game between the held row and the next: word mass moves from one to the other until a probability is 0 or 1.

    With probability down / (up + down) the held row rises by ``up``, else it falls by ``down``; either way the sum of
    size * p stays, and each p keeps its expectation. Returns the row still open (null if both ended) and those ended.
    """
    ratio = row["size"] / held["size"]
    up = F.least(1 - held["p"], row["p"] * ratio)
    down = F.least(held["p"], (1 - row["p"]) * ratio)
    rises = _unit(F.lit(seed), F.lit(level), held["doc_id"], row["doc_id"], held["u"], row["u"]) * (up + down) < down
    full = rises & (1 - held["p"] <= row["p"] * ratio)          # held ends at 1
    spent = ~rises & (held["p"] <= (1 - row["p"]) * ratio)      # held ends at 0
    held_p = F.when(full, 1.0).when(spent, 0.0).when(rises, held["p"] + up).otherwise(held["p"] - down)
    row_p = F.when(rises, F.when(full, row["p"] - up / ratio).otherwise(0.0)).otherwise(
        F.when(spent, row["p"] + down / ratio).otherwise(1.0))
    # Rounding must leave a probability.
    moved_held = held.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), held_p)))
    moved_row = row.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), row_p)))
    held_ends = full | spent
    return F.struct(F.when(held_ends, moved_row).otherwise(moved_held).alias("open"),
                    F.when(held_ends, moved_held).otherwise(moved_row).alias("ended"))


def _round_group(rows: Column, level: int, seed: int) -> Column:
    """Plays through one bounded group; the last row stays open for the level above."""
    def step(state: Column, row: Column) -> Column:
        game = _play(state["open"], row, level, seed)
        return F.struct(game["open"].alias("open"), F.concat(state["ended"], F.array(game["ended"])).alias("ended"))

    start = F.struct(F.element_at(rows, 1).alias("open"), F.filter(rows, lambda _: F.lit(False)).alias("ended"))
    return F.aggregate(F.slice(rows, 2, F.lit(1 << 30)), start, step)


def mix(documents: DataFrame, seed: int = 20_240_918) -> DataFrame:
    """Copies per document so that each source's words come within one document of its target.

    A source's rate target / source_size is split into whole copies and a fraction; the fractions of its documents
    are rounded by pivotal games, weighted by size, in groups of about FAN_IN documents dealt by hash. Each group leaves
    one open document, and these meet in the next level of the tree until one per source is left, which is then drawn.
    A hot source is split into as many groups as its size asks for. All randomness comes from hashes, so reruns agree.

    Size 0 (null or empty text): nothing is taken. Null source: a source of its own, last. Repeated rows play
    as rows of their own. Empty table: no rows. Columns other than doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sized, seen = settled_with(narrow, "mix-sizes", F.count("*").alias("n"))
    goal = settled(targets(sized), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    named = goal.withColumns({"_rate": rate, "_whole": F.floor(rate).cast("long")}).withColumnRenamed("source", "_source")
    kept = ["doc_id", "source", "size", "source_size", "target", "whole"]
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumns(
        {"whole": F.col("_whole"), "p": F.col("_rate") - F.col("_whole"), "u": F.xxhash64("doc_id", "size", F.lit(seed))})
    still = (joined["size"] > 0) & (joined["p"] > 0)
    done = [joined.filter(~still).select(*kept, F.lit(0.0).alias("p"))]
    open_rows, level, most = joined.filter(still).select(*kept, "p", "u"), 0, seen["n"]
    while True:
        groups = ceil(most / FAN_IN)
        cell = F.pmod(F.xxhash64("u", F.lit(level)), F.lit(groups))
        row = F.struct("u", *kept, "p")
        played = open_rows.groupBy("source", cell.alias("_cell")).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
            _round_group(F.col("rows"), level, seed).alias("g"))
        table, left = settled_with(played, f"mix-level{level}", F.count("*").alias("n"))
        done.append(table.select(F.explode("g.ended").alias("r")).select(*(f"r.{c}" for c in [*kept, "p"])))
        open_rows = table.select("g.open.*").select(*kept, "p", "u")
        if groups <= 1:
            break
        level, most = level + 1, min(groups, left["n"] or 1)
    last = F.when(_unit(F.lit(seed), F.lit("last"), F.col("u")) < F.col("p"), 1.0).otherwise(0.0)
    done.append(open_rows.select(*kept, last.alias("p")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
