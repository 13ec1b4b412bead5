"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.llm.common import shuffle_width
from logvigil.session import settled_with

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest rectangle of at least n cells with a in the upper half of [0, sqrt(n)].

    The cells beyond n bound the cycle walk: a walk leaves 0..n-1 for at most a*b - n steps in a row.
    """
    root = max(1, isqrt(n))
    return min(((a, -(-n // a)) for a in range(root, max(0, root // 2), -1)), key=lambda s: (s[0] * s[1] - n, -s[0]))



def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of an alternating Feistel network over pairs (x div b, x mod b): a permutation of 0..a*b-1."""
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, step: Column) -> Column:
        odd = step % 2 == 1
        left = F.when(odd, F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), step, s["r"]), F.lit(a)), F.lit(a))).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), step, s["l"]), F.lit(b)), F.lit(b)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0..n-1. Walking on from cells at or beyond n ends within a*b - n further passes, surely."""
    a, b = domain(n)
    once = feistel(x, a, b, seed)
    if a * b == n:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once,
                       lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, b, seed)))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with a gapless global number ``row_no`` and their count.

    Rows are dealt into hash cells, numbered inside each cell in the given order, and shifted by the sizes of the cells
    before. Nothing is sorted globally; the cell sizes (a bounded table) are all that is broadcast. The numbers
    depend on the rows alone, not on files or tasks; rows equal in all order columns may swap numbers.
    """
    spark = rows.sparkSession
    cells = 4 * shuffle_width(spark)
    dealt, seen = settled_with(rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")),
                               "shard-rows", F.count("*").alias("n"))
    sizes = dealt.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = sizes.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    return (dealt.withColumn("_within", within).join(F.broadcast(before), "_cell")
            .withColumn("row_no", (F.col("_before") + F.col("_within")).cast("long"))
            .drop("_cell", "_within", "_before"), seen["n"])


def shard(documents: DataFrame, shards: int = 40, seed: int = 20_240_917) -> DataFrame:
    """Deals documents into shards whose counts are at most one apart (law ``rows``), in a reproducible random order.

    The permuted row number p gives shard p mod shards and slot p div shards, so slots are gapless from 0 and where
    a row lies can be computed from its number alone. Only (doc_id, size, crc) is shuffled, never the text.

    Null text: size 16, checksum that of the empty string. Null and repeated doc_ids are rows like any other.
    Empty table: no rows. Columns other than doc_id and text are not read.
    """
    narrow = documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, "doc_id", "size", "text_crc32")
    place = permuted(F.col("row_no"), n, seed) if n else F.col("row_no")
    return rows.withColumn("_p", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")
