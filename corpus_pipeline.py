"""The corpus pipeline: toxicity, near-dedup, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between
stages the rows are written to the shared folder and read again. Nulls, empty texts, repeated rows and empty
tables are handled as each operator's docstring says; a null doc_id passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm import mixing, oddsketch, packing, pii, toxicity
from logvigil.llm.common import read
from logvigil.llm.queries import tokenizer_file
from logvigil.session import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more are rejected; the score is computed beside the row, so nothing is shuffled."""
    net = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.kept_below(docs.select(*COLUMNS), net, 0.5)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays, once.

    Equal rows count as one; different texts under one kept doc_id all stay, as no other document holds them.
    """
    found = oddsketch.near_duplicates(docs, width=5, percent=80, name="pipeline")
    kept = settled(found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "pipeline-kept")
    # The join has placed the rows by doc_id, so dropping repeats moves no text again; a union in between would undo that.
    named = (docs.filter("doc_id IS NOT NULL").select(*COLUMNS).join(kept.hint("merge"), "doc_id", "left_semi")
             .withColumn("_digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "_digest", "lang", "source", "n_chars"]))
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed span is replaced by its kind; n_chars follows the new text. Null texts stay null."""
    spans = pii.spans_of(F.coalesce(F.col("text"), F.lit("")))
    clean = docs.select(*COLUMNS).withColumn("_spans", spans).withColumn("text", pii.redact(F.col("text"), F.col("_spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, twice or three times."""
    copies = settled(mixing.mix(docs).filter("copies > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("_copies")), "pipeline-copies")
    taken = docs.select(*COLUMNS).join(copies.hint("merge"), "doc_id")
    return taken.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS).unionByName(
        docs.filter("doc_id IS NULL").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids, each with its sequence and offset."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", one_per_group),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Classifier, tokenizer and hashed draws have no SQL form. Tests check single stages; run() itself is only tested on an empty table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
