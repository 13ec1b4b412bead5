"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.llm.common import shuffle_width
from logvigil.session import settled

WIDTH = 5
KEEP_ONE_IN = 4
#: Shingle hashes are kept when below this bound; 60 bits print as 15 hex digits.
HASH_BITS = 60


def sketch(text: Column, width: int = WIDTH, one_in: int = KEEP_ONE_IN) -> Column:
    """Sorted distinct shingle hashes below 2^60 / one_in; where none is, the smallest one, so only wordless text has none.

    The sketch of a union is the union of the sketches cut in the same way, so sketches merge. Words are runs
    without ASCII white space, lower-cased; a text of fewer words than ``width`` is a single shingle.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1)))
        whole = F.transform(starts, lambda i: F.shiftrightunsigned(
            F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(width))), 64 - HASH_BITS))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(whole)

    def cut(all_hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(all_hashes, lambda x: x < (1 << HASH_BITS) // one_in)))
        return F.when((F.size(low) > 0) | (F.size(all_hashes) == 0), low).otherwise(F.array(F.array_min(all_hashes)))

    # Binding each step to a lambda variable computes it once per row.
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return once(hashes, lambda h: once(shingled(h), cut))


def printed(hashes: Column) -> Column:
    """The sketch as text: 15 hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), HASH_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first document's shingles that the second also has, whatever their lengths."""
    return F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def followed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next document is the one before it in doc_id order.

    Ids are cut into ranges by their quantiles, and each range is one window; every range also gets, as a guest, the first
    document of the next range that has any (of the last range: the very first). So each text is shuffled once.
    """
    cells = 8 * shuffle_width(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_key"))
    cuts = ids.agg(F.percentile_approx("_key", [k / cells for k in range(1, cells)], 20 * cells).alias("c")).first()["c"]
    bounds = sorted(set(cuts or []))
    steps = range(len(bounds).bit_length() - 1, -1, -1)
    table = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    # Binary search: the number of bounds not above the key.
    cell = F.aggregate(F.array(*(F.lit(1 << s) for s in steps)), F.lit(0), lambda at, jump: F.when(
        F.coalesce(F.get(table, at + jump - 1) <= F.col("_key"), F.lit(False)), at + jump).otherwise(at))
    first = settled(ids.withColumn("_cell", cell).groupBy("_cell").agg(F.max("_key").alias("_key")), "next-first")
    # Descending ids: what follows range k is range k - 1; after the lowest comes the highest.
    below = Window.orderBy("_cell")
    guests = first.select("_key", F.coalesce(F.lead("_cell").over(below), F.min("_cell").over(Window.partitionBy())).alias("_host"))
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    visiting = keyed.join(F.broadcast(guests), "_key").groupBy("_host", "_key").agg(F.min("text").alias("text")).select(
        F.lit(None).cast("long").alias("doc_id"), "text", "_key", F.col("_host").alias("_cell"), F.lit(1).alias("_guest"))
    rows = keyed.withColumns({"_cell": cell, "_guest": F.lit(0)}).select("doc_id", "text", "_key", "_cell", "_guest")
    dealt = rows.unionByName(visiting).repartition(shuffle_width(documents.sparkSession), "_cell").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("_cell").orderBy("_guest", F.desc("_key"), "text")
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).filter("_guest = 0")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike it is to that and to the next document.

    Null text is empty. A text without words has an empty fingerprint. Equal doc_ids follow each other by text; a
    null doc_id comes last. A single document is its own next one. Empty table: no rows. Other columns are not read.
    """
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = followed(documents).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"))
