"""Exact median of a column of non-negative integers in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logvigil.session import settled_with

DIGIT_BITS = 18


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two middle values.

    Spark's ``median`` keeps every distinct value in one task. Here the two middle ranks are narrowed
    down 18 bits at a time: a round counts at most 262,144 digits per rank and hands back two rows.
    """
    values, size = settled_with(rows.select(F.col(column).cast("bigint").alias("v")).filter("v IS NOT NULL"), "totals",
                                F.count("*").alias("n"), F.max("v").alias("top"))
    if not size["n"]:
        return None
    # (rank among the values sharing the prefix, prefix) of both middles.
    middles = [((size["n"] - 1) // 2, 0), (size["n"] // 2, 0)]
    for level in range(max(0, size["top"].bit_length() - 1) // DIGIT_BITS, -1, -1):
        low = level * DIGIT_BITS
        wanted = ", ".join(f"({i}, {rank}L, {prefix}L)" for i, (rank, prefix) in enumerate(middles))
        prefixes = ", ".join(f"{prefix}L" for _, prefix in middles)
        found = rows.sparkSession.sql(f"""
            SELECT middle, rank - upto + n AS rank, shiftleft(prefix, {DIGIT_BITS}) + digit AS prefix FROM (
                SELECT *, sum(n) OVER (PARTITION BY prefix ORDER BY digit) AS upto FROM (
                    SELECT shiftright(shiftright(v, {low}), {DIGIT_BITS}) AS prefix,
                           shiftright(v, {low}) & {(1 << DIGIT_BITS) - 1}L AS digit, count(*) AS n
                    FROM {{values}} WHERE shiftright(shiftright(v, {low}), {DIGIT_BITS}) IN ({prefixes}) GROUP BY 1, 2))
            JOIN VALUES {wanted} AS w(middle, rank, prefix) USING (prefix)
            WHERE upto > rank AND upto - n <= rank ORDER BY middle""", values=values).collect()
        middles = [(r["rank"], r["prefix"]) for r in found]
    return sum(prefix for _, prefix in middles) / 2
