"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm import bytepair, caps, divergence, exact, lattice, mixing, near, negatives, passages, personal, secrets, toxicity, turns
from tagstream.llm.common import prepare, read_table
from tagstream.llm.sql import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Mixing: two domains of sources, their weights, those of their languages, and of one big source.
MIX_WEIGHTS: dict[tuple, float] = {("web",): 3, ("books",): 2, ("web", "en"): 4, ("web", "de"): 2, ("books", "en"): 2, ("web", "en", "src0"): 2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 7


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def mix_levels() -> dict[str, Column]:
    """Domain (sources whose name ends in an even digit are web), language, source."""
    domain = F.when(F.col("source").rlike("[02468]$"), "web").otherwise("books")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@query
def op1_lattice_score(spark, sf_dir):
    return lattice.score_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_mixing(spark, sf_dir):
    out = mixing.mix(read_table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
                      F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"))


@query
def op4_divergence(spark, sf_dir):
    return divergence.quality(read_table(spark, sf_dir, "documents"))


@query
def op5_near_duplicates(spark, sf_dir):
    return near.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op6_byte_bpe(spark, sf_dir):
    return bytepair.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@query
def op7_exact_duplicates(spark, sf_dir):
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="max")


@query
def op8_line_dedup(spark, sf_dir):
    out = passages.dedup_passages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_gone", "gone_lines", "text")


@query
def op9_secrets(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


@query
def op10_personal(spark, sf_dir):
    return personal.scan(read_table(spark, sf_dir, "documents"))


@query
def op11_cap_duplicates(spark, sf_dir):
    return caps.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.9)


@query
def op12_repair(spark, sf_dir):
    conversations = read_table(spark, sf_dir, "conversations")
    return turns.repair_report(conversations, turns.damaged(conversations))


@query
def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)
