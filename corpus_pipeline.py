"""Corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``documents``; the last returns the encoded documents.  The result of each stage is written
as Parquet to the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagstream.llm import bytepair, lines, mixing, near, toxicity
from tagstream.llm.common import prepare, read_table, stored, text_of
from tagstream.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels, tokenizer_file

#: Share of the remaining tokens that the mixture is given.  One epoch: what dedup took out stays out.
MIX_SHARE = 0.9


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the class-conditional models call toxic."""
    prepare(spark)
    scored = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.filter("predicted = 0").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines; a document of which no word is left goes."""
    prepare(spark)
    out = lines.dedup_lines(docs)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.filter((F.col("n_gone") == 0) | left)
    return out.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8) stays.

    A document is an id with a text: where an id has several texts each is judged by itself, and of
    rows that repeat both the first by their other columns stays.  Rows without an id all stay.
    """
    prepare(spark)
    # keys in the order of the ids, so the smallest id of a group stays
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    order = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, StringType) else number
    key = F.concat_ws(":", order, F.hex(F.xxhash64(text_of("text"))))
    rows = docs.select(F.struct(*docs.columns).alias("r"), F.when(F.col("doc_id").isNotNull(), key).alias("key"), F.col("text"))
    named = rows.filter("key is not null")
    found = near.near_duplicates(named, shingle=5, percent=80, id_col="key")
    kept = named.join(found.filter("not kept").select("key").distinct(), "key", "left_anti")
    repeats = stored(named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "pipeline-repeats")
    once = kept.join(repeats, "key", "left_anti").select("r")
    first = kept.join(repeats, "key").groupBy("key").agg(F.min("r").alias("r")).select("r")
    return once.union(first).union(rows.filter("key is null").select("r")).select("r.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: each leaf gives the prefix of its seeded epoch."""
    prepare(spark)
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, 1, MIX_SEED).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, offsets of every text."""
    prepare(spark)
    return bytepair.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxic), ("line_dedup", repeated_lines), ("near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", encoded)]

#: Models and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
