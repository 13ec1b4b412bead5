"""Source divergence audit: which sources of a language use its kept terms unlike the others, by iceberg prefix refinement."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.session import settled

THRESHOLD = 10
TOP = 10
#: Byte lengths of the prefixes that are counted one after the other before complete terms are.
LEVELS = (3, 5, 8)
#: Bits of the filter of surviving prefixes that tasks receive: a fixed 2 MB, whatever the input. Prefixes that share a bit with a surviving
#: one are only refined in vain; every count is exact.
FILTER_BITS = 1 << 24
#: Terms are indexed in blocks of about this many bytes of text, and of fewer documents than 16 bits count.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 60_000
SCALE = 1_000_000_000
BLOCKS = "lang string, sources array<string>, source_of binary, terms binary, size binary, doc binary, n binary"
# Bytes of words stay, capital letters A-Z become small, every other ASCII character parts words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def _block(lang: str, rows: list[tuple[str, bytes]]) -> tuple:
    """Inverted index of the texts of one language: per term its documents and how often it stands in each."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in text.translate(WORD_BYTES).split()] for _, text in rows]
    term = np.fromiter((i for w in words for i in w), np.int64, sum(map(len, words)))
    key, n = np.unique(term * len(rows) + np.repeat(np.arange(len(rows)), list(map(len, words))), return_counts=True)
    sources = list(dict.fromkeys(s for s, _ in rows))
    at = {s: i for i, s in enumerate(sources)}
    return (lang, sources, np.array([at[s] for s, _ in rows], "<u2").tobytes(), b"\0".join(number),
            np.bincount(key // len(rows), minlength=len(number)).astype("<u4").tobytes(), (key % len(rows)).astype("<u2").tobytes(), n.astype("<u4").tobytes())


def index_terms(documents: DataFrame) -> DataFrame:
    """Blocks of the inverted index; a block holds documents of one language and one task."""
    def run(batches):
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def flush(langs):
            made = [_block(lang, held.pop(lang)) for lang in langs]
            for lang in langs:
                sizes.pop(lang)
            columns = list(zip(*made))
            types = [pa.string(), pa.list_(pa.string())] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                held.setdefault(lang or "", []).append((source or "", raw))
                sizes[lang or ""] = sizes.get(lang or "", 0) + len(raw) + 50
                if sum(sizes.values()) > BLOCK_BYTES or len(held[lang or ""]) >= BLOCK_ROWS:
                    yield flush([max(sizes, key=sizes.get)])
        if held:
            yield flush(list(held))

    return documents.select("text", "lang", "source").mapInArrow(run, BLOCKS)


class _Terms:
    """The terms of a block as one byte array, for work on all of them at once."""

    def __init__(self, lang: str, blob: bytes):
        self.bytes = np.frombuffer(blob + b"\0", np.uint8) if blob else np.zeros(0, np.uint8)
        stop = np.flatnonzero(self.bytes == 0)
        self.start = np.append(0, stop[:-1] + 1)[:len(stop)]
        self.length = stop - self.start
        self.salt = np.uint64(zlib.crc32(lang.encode()))
        self.blob = blob

    def prefix(self, length: int) -> np.ndarray:
        """The first ``length`` bytes, at most 8, as one number; what a shorter term lacks is zero, which no term holds."""
        code = np.zeros(len(self.start), np.uint64)
        for i in range(length):
            byte = np.where(i < self.length, self.bytes[np.minimum(self.start + i, len(self.bytes) - 1)], 0).astype(np.uint64)
            code |= byte << np.uint64(8 * (7 - i))
        return code

    def whole(self) -> np.ndarray:
        """A 64-bit mix of each complete term."""
        place = np.arange(len(self.bytes)) - np.repeat(self.start, self.length + 1)
        mixed = (self.bytes.astype(np.uint64) + np.uint64(1)) * _power(place)
        return np.add.reduceat(mixed, self.start) if len(self.start) else np.zeros(0, np.uint64)

    def slots(self, length: int, bits: int) -> np.ndarray:
        code = self.whole() if length > 8 else self.prefix(length)
        return slots_of(code, self.salt, bits)

    def alive(self, length: int, keep: np.ndarray | None) -> np.ndarray:
        """Which terms have their prefix of ``length`` bytes in the filter."""
        if keep is None:
            return np.ones(len(self.start), bool)
        slots = self.slots(length, 8 * len(keep))
        return (keep[slots >> 3] >> (slots & 7) & 1).astype(bool)


def _power(place: np.ndarray) -> np.ndarray:
    """Odd multiplier of each place in a term, by a 64-bit finaliser."""
    x = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def slots_of(code: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
    """Filter bit of each prefix of a language; ``bits`` is a power of two."""
    x = (code ^ (code >> np.uint64(31)) ^ (salt << np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) & (bits - 1)


def _rows(batch: pa.RecordBatch):
    """Blocks of a batch one after the other, with their terms."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        yield row, _Terms(row["lang"], row["terms"])


def count_prefixes(blocks: DataFrame, length: int, before: int, keep, bits: int = FILTER_BITS) -> DataFrame:
    """Rows (lang, prefix, slot, docs): in how many documents each prefix of ``length`` bytes begins a term, and its filter bit.

    Only terms whose prefix of ``before`` bytes survived are looked at. Prefixes are numbers up to 8 bytes, bytes beyond.
    """
    number = length <= 8

    def run(batches):
        held = None if keep is None else np.frombuffer(keep.value, np.uint8)
        for batch in batches:
            for row, terms in _rows(batch):
                alive = np.flatnonzero(terms.alive(before, held))
                rows = max(1, len(row["source_of"]) // 2)
                if number:
                    code, of_term = np.unique(terms.prefix(length)[alive], return_inverse=True)
                    slot, prefix = slots_of(code, terms.salt, bits), pa.array(code.view(np.int64))
                else:
                    of_term, slot = np.arange(len(alive)), terms.slots(length, bits)[alive]
                    prefix = pa.array(terms.blob.split(b"\0") if terms.blob else [], pa.binary()).take(pa.array(alive))
                at = np.full(len(terms.start), -1, np.int64)
                at[alive] = of_term
                of_posting = np.repeat(at, np.frombuffer(row["size"], "<u4"))
                chosen = of_posting >= 0
                pair = of_posting[chosen] * rows + np.frombuffer(row["doc"], "<u2")[chosen]
                # Of complete terms every posting is another document; of prefixes a document may have several terms.
                docs = np.bincount((np.unique(pair) if number else pair) // rows, minlength=len(slot))
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(slot), pa.string()), prefix, pa.array(slot, pa.int64()),
                                                  pa.array(docs.astype(np.int64))], names=["lang", "prefix", "slot", "docs"])

    kind = "long" if number else "binary"
    return (blocks.select("lang", "source_of", "terms", "size", "doc").mapInArrow(run, f"lang string, prefix {kind}, slot long, docs long")
            .groupBy("lang", "prefix", "slot").agg(F.sum("docs").alias("docs")))


def filter_of(survivors: DataFrame, bits: int = FILTER_BITS):
    """The survivors' bits as one broadcast value of ``bits`` / 8 bytes; the pieces are put together by Spark."""
    spark = survivors.sparkSession
    pieces = (survivors.selectExpr("slot + 1 AS slot").groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
              .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect())
    whole = bytearray(bits // 8)
    for piece in pieces:
        start = (piece["bucket"] - 1) * 4096
        whole[start:start + 4096] = piece["bits"][:bits // 8]
    return spark.sparkContext.broadcast(bytes(whole))


def count_terms(blocks: DataFrame, keep) -> DataFrame:
    """Rows (lang, source, term, n): occurrences of the terms whose bit is in the filter."""
    def run(batches):
        held = np.frombuffer(keep.value, np.uint8)
        for batch in batches:
            for row, terms in _rows(batch):
                size = np.frombuffer(row["size"], "<u4")
                chosen = np.repeat(terms.alive(1 << 30, held), size)
                term = np.repeat(np.arange(len(size)), size)[chosen]
                source = np.frombuffer(row["source_of"], "<u2")[np.frombuffer(row["doc"], "<u2")][chosen]
                width = len(row["sources"])
                cell, place = np.unique(term * width + source, return_inverse=True)
                # Float sums are exact here: a block has far fewer than 2 ** 53 words.
                n = np.bincount(place, weights=np.frombuffer(row["n"], "<u4")[chosen], minlength=len(cell)).astype(np.int64)
                words = pa.array(terms.blob.split(b"\0") if terms.blob else [], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"]] * len(cell), pa.string()), pa.array(row["sources"], pa.string()).take(pa.array(cell % width)),
                    words.take(pa.array(cell // width)), pa.array(n)], names=["lang", "source", "term", "n"])

    return blocks.mapInArrow(run, "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def kept_terms(documents: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, counts): all (lang, source); kept (lang, term, docs); counts (lang, source, term, n > 0) of kept terms.

    The texts are read once, into blocks of an inverted index. Then prefixes of growing byte length are counted: a
    level extends only terms whose prefix at the level before stands in ``threshold`` documents, since a term stands in no more
    documents than its prefix does. What is left of rare terms at the end is one row a term and task, and never a row a source.
    """
    blocks = settled(index_terms(documents), "terms-blocks")
    keep, before, bits = None, 0, FILTER_BITS
    for length in (*LEVELS, 1 << 30):
        counted = count_prefixes(blocks, length, before, keep, bits).filter(F.col("docs") >= threshold)
        survivors = settled(counted, "terms-survivors")
        if keep is not None:
            keep.unpersist()
        keep, before = filter_of(survivors, bits), length
    kept = survivors.select("lang", F.col("prefix").alias("term"), "docs")
    counts = settled(count_terms(blocks, keep).join(kept.select("lang", "term"), ["lang", "term"], "left_semi"), "terms-counts")
    groups = settled(blocks.select("lang", F.explode("sources").alias("source")).distinct(), "terms-groups")
    return groups, kept, counts


def share(n: str, total: str) -> Column:
    """p of a term: its smoothed share of the kept terms in billionths, rounded down, plus one. Products exceed 64 bits, so decimals."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(18,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0))")


def distance(p: str, q: str) -> Column:
    """f of two shares; the square stays below 2 ** 63, as shares do not exceed a billion and one."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _joint(batches):
    """Per batch of terms, for each two sources: the sum over terms that both have of what the one-sided sums get wrong."""
    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        rows: dict[str, list] = {}
        for lang, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.setdefault(lang, []).append(entries)
        for lang, terms in rows.items():
            zero = {e["source"]: e["zero"] for entries in terms for e in entries}
            names = sorted(zero)
            at, none = {s: i for i, s in enumerate(names)}, np.array([zero[s] for s in names], np.int64)
            total = np.zeros((len(names), len(names)), np.int64)
            step = max(1, (1 << 21) // len(names))
            for start in range(0, len(terms), step):
                part = terms[start:start + step]
                p = np.zeros((len(names), len(part)), np.int64)
                for i, entries in enumerate(part):
                    for e in entries:
                        p[at[e["source"]], i] = e["p"]
                for a in range(len(names) - 1):
                    has = np.flatnonzero(p[a])
                    x, y, z = p[a, has], p[a + 1:, has], none[a + 1:, None]
                    wrong = f(x, np.maximum(y, 1)) - f(x, z) - f(none[a], np.maximum(y, 1)) + f(none[a], z)
                    total[a, a + 1:] += np.where(y > 0, wrong, 0).sum(axis=1)
            a, b = np.triu_indices(len(names), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a.tolist()], pa.string()),
                                              pa.array([names[i] for i in b.tolist()], pa.string()), pa.array(total[a, b])],
                                             names=["lang", "one", "two", "joint"])


def audit(documents: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair`` has each other source of the language with the sum of f over all kept terms. Terms that a source lacks
    all have the same share there, so the sum over them follows from how often each count occurs in the other source; only
    terms that both have are compared one by one, inside a task, and summed before anything is shuffled. Part ``term`` has the
    ``top`` kept terms that the source uses more than its language does.

    Null text, lang and source are read as empty; an empty text only makes its (lang, source) occur; very long texts
    are one block; rows are documents, so repeated rows and equal or null doc_ids count as often as they stand there; ties rank by the
    item's bytes; an empty table gives no rows; languages without kept terms have pairs of value 0. Columns other than text, lang and
    source are not read.
    """
    groups, kept, counts = kept_terms(documents, threshold)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("has"))
    # Per group: v kept terms in its language, has of them in itself, total under its shares, zero the share of a term it lacks.
    group = settled(groups.join(vocabulary, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["v", "n", "has"])
                    .withColumn("total", F.expr("nullif(n + 2 * v, 0)")).withColumn("zero", share("0", "total")), "terms-groups-sized")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_total = group.groupBy("lang").agg(F.expr("sum(n) + 2 * max(v)").alias("lang_total"))
    shares = counts.join(group.select("lang", "source", "total", "zero"), ["lang", "source"]).withColumn("p", share("n", "total"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (shares.join(whole, ["lang", "term"]).join(lang_total, "lang").withColumn("q", share("lang_n", "lang_total")).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), distance("p", "q").alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))

    one = group.select("lang", F.col("source").alias("one"), F.col("has").alias("has_one"), F.col("zero").alias("zero_one"), "v")
    two = group.select("lang", F.col("source").alias("two"), F.col("has").alias("has_two"), F.col("zero").alias("zero_two"))
    # One-sided sums: how many terms of a source have each share, against the share of absent terms in every other source.
    often = shares.groupBy("lang", F.col("source").alias("one"), "p").agg(F.count("*").alias("h"))
    sided = (often.join(two, "lang").filter("one <> two").groupBy("lang", "one", "two")
             .agg(F.sum(F.col("h") * distance("p", "zero_two")).alias("sided")))
    entries = F.collect_list(F.struct("source", "p", "zero")).alias("entries")
    joint = (shares.groupBy("lang", "term").agg(entries).select("lang", "entries").mapInArrow(_joint, "lang string, one string, two string, joint long")
             .groupBy("lang", "one", "two").agg(F.sum("joint").alias("joint")))
    pairs = one.join(two, "lang").filter("one < two")
    back = sided.select("lang", F.col("one").alias("two"), F.col("two").alias("one"), F.col("sided").alias("back"))
    both = ["lang", "one", "two"]
    valued = (pairs.join(sided, both, "left").join(back, both, "left").join(joint, both, "left").na.fill(0, ["sided", "back", "joint"])
              .withColumn("value", F.col("sided") + F.col("back") + F.col("joint") +
                          F.coalesce((F.col("v") - F.col("has_one") - F.col("has_two")) * distance("zero_one", "zero_two"), F.lit(0).cast("long"))))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pair = (valued.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
            .withColumn("rank", F.row_number().over(ranked)))
    return pair.unionByName(terms)
