"""Reading raw log files as numbered lines."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logvigil.operators.intervals import UNBOUNDED
from logvigil.session import counted_small, settled, side_by_side

# White space stripped from lines, and line breaks Spark's reader does not split on.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ANY_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Printable ASCII without a space at either end: nothing to cut, to repair or to strip.
PLAIN = r"^[!-~](?:[ -~]*[!-~])?\z"
# First bytes of binary files, as hex.
SIGNATURES = ["89504E47", "FFD8FF", "47494638", "25504446", "504B0304", "1F8B", "7F454C46", "4D5A", "424D",
              "52494646", "00000100"]
HEAD_BYTES = 8192
VOTING_LINES = 50
HEADS = "file string, size long, head binary, lines array<binary>, held long"
#: Files up to this size are read whole for their heads; longer ones are read up to a limit, this many in one job.
WHOLE_BYTES = 1 << 20
GROUP = 50


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, block, value`` of text files, in order inside a block."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def cut_lines(scanned: DataFrame) -> DataFrame:
    """``file, block, pos, raw`` and other columns: remaining line breaks cut, damage removed, white space stripped.

    pos grows by one with each line in the order in which a task reads them, blank lines included.
    """
    clean = F.btrim(F.make_valid_utf8(F.translate("text", "\x00", "")), F.lit(SPACES))
    parts = F.when(F.col("plain"), F.array("value")).otherwise(F.split("value", OTHER_BREAKS))
    return (scanned.select("file", "block", "value", F.col("value").rlike(PLAIN).alias("plain"))
            .select("file", "block", "plain", F.explode(parts).alias("text"))
            .select("file", "block", F.monotonically_increasing_id().alias("pos"), F.when(F.col("plain"), F.col("text")).otherwise(clean).alias("raw")))


def block_starts(stored: DataFrame) -> DataFrame:
    """``file, block, shift`` of written lines: what turns the pos of a block's lines into line numbers.

    A block's summary is its first pos and its number of lines, which Spark folds where the lines lie; only one row a block is moved,
    and the numbers of lines are summed up over the blocks of a file.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(UNBOUNDED, -1)
    blocks = stored.groupBy("file", "block").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    shift = F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")) + 1 - F.col("first")
    return blocks.select("file", "block", shift.alias("shift"))


def numbered_lines(stored: DataFrame) -> DataFrame:
    """Written lines with ``line_no``, blank ones dropped. The rows stay where they are: the shifts come to them, within a counted bound."""
    starts = counted_small(settled(block_starts(stored), "block-starts"))
    return (stored.join(starts, ["file", "block"]).filter("raw != ''")
            .withColumn("line_no", F.col("pos") + F.col("shift")).drop("block", "pos", "shift"))


def number_lines(scanned: DataFrame) -> DataFrame:
    """``file, line_no, raw``: 1-based numbers that count blank lines, then blank lines dropped.

    The lines of a (file, block) must follow each other in one partition, as file readers give them. They are written
    there and numbered by a table with one row per block.
    """
    return numbered_lines(settled(cut_lines(scanned), "lines-cut")).select("file", "line_no", "raw")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return number_lines(scan_lines(spark, paths))


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, path, size, position`` of every file in the order given; contents are not opened.

    Files without a single byte are not listed: Spark's readers pass over them.
    Fails where several of the given paths reach the same file, as its lines would be read several times.
    """
    # The name comes as part of a URI, in which a plus sign stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    each = [spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), name.alias("path"), F.col("_metadata.file_size").alias("size"),
        F.lit(i).alias("given")) for i, path in enumerate(paths)]
    files = reduce(DataFrame.unionByName, each)
    twice = files.groupBy("file").count().filter("count > 1").orderBy("file").first()
    if twice is not None:
        raise ValueError(f"several of the given paths reach {twice.file}")
    return files.select("file", "path", "size", F.struct("given", "file").alias("position"))


def unique_names(files: DataFrame) -> DataFrame:
    """Adds ``name`` to ``position, path``: the base name, with _2, _3, ... before the extension on repeats (S3)."""
    base = F.when(F.coalesce(F.col("path"), F.lit("")) == "", "upload.log").otherwise(F.substring_index("path", "/", -1))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("position"))
    # The extension starts at the last dot that follows something other than dots.
    stem = F.regexp_extract("base", r"^(\.*[^.].*)(\.[^.]*)$", 1)
    extension = F.regexp_extract("base", r"^(\.*[^.].*)(\.[^.]*)$", 2)
    root = F.when(stem == "", F.col("base")).otherwise(stem)
    return (files.withColumn("base", base).withColumn("nth", nth)
            .withColumn("name", F.when(F.col("nth") == 1, F.col("base")).otherwise(
                F.concat(root, F.lit("_"), F.col("nth").cast("string"), extension))).drop("base", "nth"))


def control_bytes(head: Column) -> Column:
    """Number of control bytes. One byte is one character in Latin-1, so byte counts are character counts."""
    return F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x00-\x08\x0e-\x1f]", ""))


def has_signature(head: Column) -> Column:
    return F.hex(F.substring(head, 1, 4)).rlike("^(" + "|".join(SIGNATURES) + ")")


def is_binary_head(head: Column) -> Column:
    """Known signatures, or more than 10 % control bytes."""
    return has_signature(head) | (control_bytes(head) * 10 > F.length(head))


def _take_heads(batches):
    """One row per file of its first bytes and its first lines with content; the lines of a file follow each other."""
    def row(file, size, head, lines, held):
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([bytes(head[:min(size, HEAD_BYTES)])], pa.binary()),
                                           pa.array([lines], pa.list_(pa.binary())), pa.array([held], pa.int64())], names=["file", "size", "head", "lines", "held"])

    file, size, head, lines, held = None, 0, bytearray(), [], 0
    for batch in batches:
        for name, length, value in zip(*(c.to_pylist() for c in batch.columns)):
            if name != file:
                if file is not None:
                    yield row(file, size, head, lines, held)
                file, size, head, lines, held = name, length, bytearray(), [], 0
            if len(head) < HEAD_BYTES:
                head += value[:HEAD_BYTES] + b"\n"
            if held < VOTING_LINES:
                parts = re.split(ANY_BREAK, value.replace(b"\0", b"").decode("utf-8", "replace"))
                content = sum(1 for part in parts if part.strip(SPACES))
                held += content
                if content:
                    lines.append(value)
    if file is not None:
        yield row(file, size, head, lines, held)


def _readable(file: str) -> str:
    """A path for Spark's readers from the URI of a file: no escapes, and no character that would stand for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _heads_of(session: SparkSession, groups: list[tuple[list[str], int | None]]) -> DataFrame:
    """Heads of groups of files read together, each up to a number of lines; whole where that is None."""
    def lines(files, limit):
        rows = session.read.text(files, lineSep="\n").select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
        return rows if limit is None else rows.limit(limit)

    each = [lines(files, limit).mapInArrow(_take_heads, HEADS) for files, limit in groups]
    return settled(reduce(DataFrame.unionByName, each), "heads")


def file_heads(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``file, size, head, lines, held`` per file of ``file, size``: its first 8 KiB and its first 50 lines with content, or all it has.

    Files up to ``WHOLE_BYTES`` are read whole, many in a task. A longer one is one split of its own behind a limit of lines,
    which ends the reading of the file: 8,192 lines, since every line takes a byte or more of the head. Only where these hold fewer
    than 50 lines with content are more of them read. So the bytes read do not grow with a file. The limits are planned
    for groups of files, several groups at a time.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    own.conf.set("spark.sql.files.openCostInBytes", str(WHOLE_BYTES))
    listed = files.select("file", "size").toLocalIterator()
    small, long = [], []
    for row in listed:
        (small if row["size"] <= WHOLE_BYTES else long).append(_readable(row["file"]))
    jobs = [[(small[i:i + 10_000], None)] for i in range(0, len(small), 10_000)]
    jobs += [[([name], HEAD_BYTES) for name in long[i:i + GROUP]] for i in range(0, len(long), GROUP)]
    if not jobs:
        return spark.createDataFrame([], HEADS)

    def back(frames: list[DataFrame]) -> DataFrame:
        """The written heads in the caller's session."""
        return settled(reduce(DataFrame.unionByName, frames), "heads-all", reader=spark)

    heads = back(side_by_side(*[lambda job=job: _heads_of(own, job) for job in jobs], at_once=4))
    short = [_readable(r["file"]) for r in heads.filter(F.col("held") < VOTING_LINES).filter(F.col("size") > WHOLE_BYTES).select("file").toLocalIterator()]
    if not short:
        return heads
    # Many blank lines at the head: the first lines with a visible byte are looked for further on.
    found = [own.read.text([name], lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                                                       F.col("value").cast("binary").alias("value"))
             .filter(F.btrim(F.make_valid_utf8(F.translate("value", "\x00", "")), F.lit(SPACES)) != "").limit(VOTING_LINES)
             .mapInArrow(_take_heads, HEADS) for name in short]
    more = settled(reduce(DataFrame.unionByName, found), "heads-more", reader=spark).select("file", F.col("lines").alias("more"), F.col("held").alias("more_held"))
    return heads.join(more, "file", "left").select("file", "size", "head", F.coalesce("more", "lines").alias("lines"), F.coalesce("more_held", "held").alias("held"))


def head_lines(heads: DataFrame) -> DataFrame:
    """``file, n, raw``: the lines of the heads in order, as ``cut_lines`` gives those of whole files."""
    text = F.make_valid_utf8(F.translate(F.col("text"), "\x00", ""))
    return (heads.select("file", F.posexplode("lines").alias("line", "value"))
            .select("file", "line", F.posexplode(F.split(F.col("value").cast("string"), ANY_BREAK)).alias("part", "text"))
            .select("file", F.struct("line", "part").alias("n"), F.btrim(text, F.lit(SPACES)).alias("raw")).filter("raw != ''"))


def judge_uploads(uploads: DataFrame) -> DataFrame:
    """Adds ``is_binary`` and ``text`` to rows with ``content``, judged by the same rule as the heads of files."""
    binary = is_binary_head(F.substring("content", 1, HEAD_BYTES))
    text = F.translate(F.make_valid_utf8(F.col("content").cast("string")), "\x00", "")
    return uploads.withColumn("is_binary", binary).withColumn("text", F.when(~binary, text)).drop("content")
