"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full shingle sets decide."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import components
from logvigil.session import settled, settled_with

BANDS, ROWS = 32, 5
#: Bits of an odd sketch.
BITS = 512
_FACTORS = np.random.default_rng(61).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased: a running polynomial per byte, cut at white space."""
    if not text.strip():
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.lower(), np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    powers, inverse = _powers(1 << int(len(raw)).bit_length())
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers[:len(raw)], dtype=np.uint64)])
    # The inverse power takes every word back to the text's origin.
    return mixed((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the odd base and of its inverse modulo 2^64."""
    n = max(n, 1 << 16)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)]), dtype=np.uint64) for b in (_BASE, inverse))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one shingle, one without words has none."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k:k + n] + np.uint64(k + 1))
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash samples of a shingle set, in slices so that a very long document needs no more memory than a slice."""
    low = np.full(_FACTORS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 1024):
        part = sets[at:at + 1024, None] * _FACTORS[0] + _FACTORS[1]
        np.minimum(low, part.min(0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> list[int]:
    """Each sample toggles one bit: the bitmap's parity survives where two documents' samples differ."""
    bits = mixed(samples + np.arange(1, len(samples) + 1, dtype=np.uint64)) % np.uint64(BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64).tolist()


def most_differing(threshold: float) -> int:
    """XOR population count that pairs at the threshold exceed with a chance below one in a million.

    Pairs of similarity s differ in about k (1 - s) of k samples, each a toggle in both bitmaps. The bound is five standard
    deviations, of the number of differing samples and of where their toggles fall, above the expected count.
    """
    k = BANDS * ROWS
    toggles = 2 * k * (1 - threshold)
    mean = BITS / 2 * (1 - np.exp(-2 * toggles / BITS))
    by_samples = 2 * np.exp(-2 * toggles / BITS) * np.sqrt(k * threshold * (1 - threshold))
    by_bits = np.sqrt(BITS / 4 * (1 - np.exp(-4 * toggles / BITS)))
    return int(np.ceil(mean + 5 * np.hypot(by_samples, by_bits)))


def _described(width: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sets = shingles(text.as_py(), width)
                    if not len(sets):
                        rows.append((doc_id, 0, None, None, None))
                        continue
                    # Two sums of the set's hashes name the set: equal sets are one class.
                    name = mixed(np.array([sets.sum(), mixed(sets).sum()], np.uint64)).tobytes()
                    low = signature(sets)
                    bands = mixed(low.reshape(BANDS, ROWS) * _FACTORS[0, :ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64)
                    rows.append((doc_id, len(sets), name, odd_sketch(low), mixed(bands).view(np.int64).tolist()))
                ids, n, names, odd, keys = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(odd, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "name", "odd", "bands"])
    return run


def _decided(width: int, percent: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                links, last, of_last = [], None, None
                for x, y, left, right in zip(a, b, batch.column(2), batch.column(3)):
                    if last != x:
                        last, of_last = x, shingles(left.as_py(), width)
                    other = shingles(right.as_py(), width)
                    both = len(np.intersect1d(of_last, other, assume_unique=True))
                    if 100 * both >= percent * (len(of_last) + len(other) - both):
                        links.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                                                 names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) of class representatives that pass the odd-sketch sieve and then the exact test on full sets."""
    odd = classes.select("rep", "odd")
    differing = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    near = settled(pairs.join(odd.toDF("a", "odd_a").hint("merge"), "a").join(odd.toDF("b", "odd_b").hint("merge"), "b")
                   .filter(differing <= most_differing(percent / 100)).select("a", "b").distinct(), f"{name}-near")
    both = near.join(texts.toDF("a", "left").hint("merge"), "a").join(texts.toDF("b", "right").hint("merge"), "b")
    return settled(both.select("a", "b", "left", "right").mapInArrow(_decided(width, percent), "a long, b long").distinct(), f"{name}-links")


def _between(width: int, percent: int):
    """One block of a bucket: its outliers against all its rows. Only links that join what is still apart are emitted."""
    most = most_differing(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            reps, home = table["rep"].to_numpy(), table["c"].to_numpy()
            outlier = table["outlier"].to_numpy(zero_copy_only=False).astype(bool)
            odd = np.array(table["odd"].to_pylist(), np.int64).view(np.uint64)
            bands = np.array(table["bands"].to_pylist(), np.int64)
            key, texts, sets, root, links = table["key"][0].as_py(), table["text"], {}, {}, []

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def set_of(i):
                if i not in sets:
                    sets[i] = shingles(texts[int(i)].as_py(), width)
                return sets[i]

            for i in np.flatnonzero(outlier):
                # Each pair is compared in the first bucket that both share, and two outliers from one side only.
                shared = bands == bands[i]
                here = shared.any(1) & (bands[i][shared.argmax(1)] == key)
                apart = np.bitwise_count(odd ^ odd[i]).sum(1) <= most
                for j in np.flatnonzero(here & apart & (home != home[i]) & (~outlier | (reps < reps[i]))):
                    a, b = find(home[i]), find(home[j])
                    if a == b:
                        continue
                    both = len(np.intersect1d(set_of(i), set_of(j), assume_unique=True))
                    if 100 * both >= percent * (len(set_of(i)) + len(set_of(j)) - both):
                        root[max(a, b)] = min(a, b)
                        links.append((reps[i], reps[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return run


def across(placed: DataFrame, texts: DataFrame, classes: DataFrame, width: int, percent: int, name: str, block: int = 1024) -> DataFrame:
    """Links between members of one bucket that are in different components.

    The largest component of a bucket needs no comparisons inside itself; what must be compared are the other members
    (outliers) with all. Both kinds are cut into blocks of bounded size by hash, and every block of outliers meets every
    block of the rest and of the outliers, so no task holds more than two blocks and no pair is a row.
    """
    per = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    keys = settled(per.select("key", F.col("top.c").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("n_out"),
                              F.ceil(F.col("n") / block).cast("int").alias("n_all")), f"{name}-mixed")
    still = settled(placed.join(keys.hint("merge"), "key").withColumn("outlier", F.col("c") != F.col("main")), f"{name}-still")
    hashed = F.xxhash64("rep")
    facing = F.explode(F.sequence(F.lit(0), F.col("n_out") - 1))
    # Every row stands once for each block of outliers; an outlier of another block than the facing one is just a row there.
    rows = still.withColumns({"_out": facing, "_block": F.pmod(hashed, F.col("n_all"))})
    of_block = F.pmod(hashed, F.col("n_out")) == F.col("_out")
    guests = still.filter("outlier").withColumn("_out", F.pmod(hashed, F.col("n_out"))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    plain = rows.filter(~(F.col("outlier") & of_block)).withColumn("outlier", F.lit(False))
    wanted = plain.select("key", "rep", "c", "outlier", "_out", "_block").unionByName(
        guests.select("key", "rep", "c", "outlier", "_out", "_block"))
    full = classes.select("rep", "odd", "bands").join(texts.toDF("rep", "text").hint("merge"), "rep")
    return settled(wanted.join(settled(full, f"{name}-full").hint("merge"), "rep").groupBy("key", "_out", "_block")
                   .applyInArrow(_between(width, percent), "a long, b long").distinct(), f"{name}-across")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, name: str = "odd") -> DataFrame:
    """Component of every document under links of shingle-set similarity >= percent / 100.

    Documents of equal sets are one class. Of each band's bucket, a leader is compared with all members. Then only members
    in different components can add anything: those outside a bucket's largest component are compared with all, in
    blocks. So a bucket of near copies costs a star of pairs and a few outliers, no link between components is lost, and
    no bucket is cut off. Only pairs that share none of the bands are missed: at the threshold with a chance of
    (1 - 0.8^5)^32 = 3 in a million.

    Without words (or null text): set size 0, linked with nothing. Null doc_id: kept, component null. Rows that share
    a doc_id are one document, linked if any of its texts is. Empty table: no rows. Further columns are not read.
    """
    narrow = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    described = settled(narrow.mapInArrow(_described(width), "doc_id long, n_shingles long, name binary, odd array<long>, bands array<long>"),
                        f"{name}-described")
    classes, seen = settled_with(
        described.filter("name IS NOT NULL AND doc_id IS NOT NULL").groupBy("name").agg(F.min(F.struct("doc_id", "odd", "bands")).alias("m"))
        .select("name", F.col("m.doc_id").alias("rep"), "m.odd", "m.bands"), f"{name}-classes", F.count("*").alias("n"))
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    shared = settled(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1"), f"{name}-shared")
    members = settled(buckets.join(shared.hint("merge"), "key").select("key", "rep", "leader"), f"{name}-members")
    asked = settled(members.select("rep").distinct(), f"{name}-asked")
    texts = settled(narrow.join(asked.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "text"), f"{name}-texts")
    links = confirmed(members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(),
                      texts, classes, width, percent, name)
    home = components(links, name)
    placed = settled(members.join(home.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
                     .select("key", "rep", F.coalesce("root", "rep").alias("c")), f"{name}-placed")
    more = across(placed, texts, classes, width, percent, name)
    # Links between components, not documents: the known components join as stars.
    home = components(links.unionByName(more), name)
    homes = settled(classes.select("name", "rep").join(home.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
                    .select("name", F.coalesce("root", "rep").alias("component_id")), f"{name}-homes")
    worded = described.filter("name IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "name")
    alone = described.filter("name IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = worded.join(homes.hint("merge"), "name").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
