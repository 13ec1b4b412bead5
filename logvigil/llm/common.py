"""What several operators share: tables, cell counts and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.session import settled, settled_with


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _contract(batches):
    """Union-find over one Arrow batch of links: each node with the smallest node it reaches inside the batch."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up] = root.setdefault(up, up)
                x = root[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())],
                                         names=["c", "p"])


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), one per node that has a smaller one in reach.

    Links are first contracted batch by batch inside their tasks. Alternating large-star and small-star steps
    then run until nothing changes; there is no limit of rounds. Every step is written to the shared folder. The
    minima are written before they meet the links, so that both sides of each join are plain scans and Spark can
    split a hub's partition.
    """
    checksum = (F.count("*").alias("n"), F.sum(F.xxhash64("c", "p").cast("decimal(38,0)")).alias("h"))
    edges = settled(links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
                    .mapInArrow(_contract, "c long, p long").distinct(), f"{name}-links")
    before = None
    while True:
        both = edges.select(F.col("c").alias("u"), F.col("p").alias("v")).union(edges.select("p", "c"))
        lowest = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
        large = settled(both.join(lowest.hint("merge"), "u").filter("v > u AND v <> m").select(F.col("v").alias("c"), F.col("m").alias("p"))
                        .distinct(), f"{name}-large")
        least = settled(large.groupBy("c").agg(F.min("p").alias("m")), f"{name}-least")
        small = large.join(least.hint("merge"), "c").select(F.explode(F.array(
            F.struct(F.col("c"), F.col("m").alias("p")), F.struct(F.col("p").alias("c"), F.col("m").alias("p")))).alias("e"))
        edges, after = settled_with(small.select("e.*").filter("c <> p").distinct(), f"{name}-small", *checksum)
        if (after["n"], after["h"]) == before:
            return edges.select(F.col("c").alias("node"), F.col("p").alias("root"))
        before = (after["n"], after["h"])
