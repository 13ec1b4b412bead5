"""Embedding near-dedup: int8 tile products with a bound on their error, full precision only where the bound asks for it."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import components
from logvigil.session import settled, settled_with

THRESHOLD = 0.95
#: Most vectors on one side of a tile pair, and the side of the products held in memory at once.
TILE, STEP = 4096, 1024


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes, their scales, and a bound e on |unit - scale * codes| for each."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    scale = np.maximum(np.abs(unit).max(1, keepdims=True), 1e-300) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    error = np.sqrt(((unit - scale * codes) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes, scale[:, 0], error


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _similar(threshold: float):
    """Pairs of one tile pair with cosine at or above the threshold.

    With units u, v, codes p, q, scales s, t and errors e, f: u.v = st p.q + (u - sp).v + sp.(v - tq), so
    |u.v - st p.q| <= e + f |sp| <= e + f (1 + e). Products of int8 codes are exact in float32 up to 1,040 dimensions,
    and in float64 beyond. Only pairs whose upper bound reaches the threshold are computed again.
    """
    def run(table: pa.Table) -> pa.Table:
        left = table["side"].to_numpy() == 0
        same = bool(table["same"][0].as_py())
        ids = table["rep"].to_numpy()
        flat = table["vector"].combine_chunks()
        vectors = np.asarray(flat.flatten(), np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, left, vectors = ids[order], left[order], vectors[order]
        ia, a = ids[left], vectors[left]
        ib, b = (ia, a) if same else (ids[~left], vectors[~left])
        out_a, out_b = [], []
        if len(ia) and len(ib):
            kind = np.float32 if a.shape[1] <= 1040 else np.float64
            (p, s, e), (q, t, f) = quantised(a), quantised(b)
            p, q = p.astype(kind), q.astype(kind)
            for i in range(0, len(ia), STEP):
                for j in range(i if same else 0, len(ib), STEP):
                    product = p[i:i + STEP] @ q[j:j + STEP].T
                    # st p.q >= threshold - e - f (1 + e), loosened so that it needs one comparison a pair.
                    most = f[j:j + STEP].max()
                    need = (threshold - e[i:i + STEP] - most * (1 + e[i:i + STEP]) - 1e-9) / s[i:i + STEP]
                    x, y = np.nonzero(product * t[None, j:j + STEP].astype(kind) >= (need - 1e-3 * np.abs(need))[:, None].astype(kind))
                    x, y = x + i, y + j
                    if same:
                        x, y = x[x < y], y[x < y]
                    for k in range(0, len(x), 1 << 16):
                        xs, ys = x[k:k + (1 << 16)], y[k:k + (1 << 16)]
                        linked = cosine(a[xs], b[ys]) >= threshold
                        out_a.append(ia[xs[linked]])
                        out_b.append(ib[ys[linked]])
        none = np.zeros(0, np.int64)
        a_ids, b_ids = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
        return _tallied(a_ids, b_ids, dict(zip(ids.tolist(), table["n"].to_numpy()[order].tolist())))
    return run


def _tallied(a: np.ndarray, b: np.ndarray, copies: dict[int, int]) -> pa.Table:
    """A tile's links as sums: per class the other vectors it is linked with, and the smallest id it reaches inside the tile."""
    root: dict[int, int] = {}
    total: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        total[x] = total.get(x, 0) + copies[y]
        total[y] = total.get(y, 0) + copies[x]
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    ids = list(total)
    return pa.table({"rep": pa.array(ids, pa.int64()), "others": pa.array([total[i] for i in ids], pa.int64()),
                     "root": pa.array([find(i) for i in ids], pa.int64())})


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of all vectors by cosine, whatever their labels.

    Equal vectors are one class and are compared once. Classes are dealt into blocks of about TILE by hash; every pair of
    blocks is one task, whose memory is bounded by two blocks and one product of STEP x STEP. A class is sent once per
    block. A task returns sums and tile-local roots, never its pairs. Work is quadratic in the number of different
    vectors, as the comparison of all pairs asks for.

    Null, zero, and empty vectors and those with null or non-finite components link with nothing. Vectors of other
    lengths are compared within their length only. Null vec_id: kept, no links, component null. Repeated rows are
    vectors of their own. Empty table: no rows. Columns other than vec_id and embedding are not read.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = embeddings.select("vec_id", doubles.alias("_v")).withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)))
    # Scaling by the largest component keeps squares from over- and underflowing; adding 0.0 makes -0.0 equal to 0.0.
    top = F.array_max(F.transform("_v", lambda x: F.abs(x)))
    vectors = settled(rows.withColumn("vector", F.when(F.col("sound"), F.transform("_v", lambda x: F.when(
        (top > 1e100) | (top < 1e-100), x / top).otherwise(x) + F.lit(0.0)))).withColumn(
        "name", F.when(F.col("sound"), F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").cast("binary"), 256)))
        .select("vec_id", "vector", "name"), "emb-vectors")
    classes, seen = settled_with(vectors.filter("name IS NOT NULL").groupBy("name").agg(
        F.min(F.struct("vec_id", "vector")).alias("m"), F.count("*").alias("n")).select(
        "name", F.col("m.vec_id").alias("rep"), "m.vector", "n"), "emb-classes", F.count("*").alias("rows"))
    blocks = max(1, ceil(seen["rows"] / TILE))
    mine = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    # Block i meets blocks i..blocks-1 as the left side and 0..i-1 as the right side.
    placed = classes.select("rep", "vector", "n", mine.alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = placed.select("rep", "vector", "n", F.least("i", "j").alias("one"), F.greatest("i", "j").alias("two"),
                          (F.col("i") > F.col("j")).cast("int").alias("side"), (F.col("i") == F.col("j")).alias("same"), F.size("vector").alias("dim"))
    found = settled(tiles.groupBy("one", "two", "dim").applyInArrow(_similar(threshold), "rep long, others long, root long"), "emb-links")
    home = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "emb")
    others = settled(found.groupBy("rep").agg(F.sum("others").alias("others")), "emb-others")
    homes = settled(classes.select("name", "rep", "n").join(others.hint("merge"), "rep", "left").join(
        home.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "name", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "emb-homes")
    linked = vectors.filter("name IS NOT NULL").select("vec_id", "name").join(homes.hint("merge"), "name").select("vec_id", "n_links", "component_id")
    alone = vectors.filter("name IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
