"""Running totals (T4, X2) and online thresholds (T5, X3) over an ordered feed, with carried state.

Each micro-batch is one job: rows are cut into blocks, blocks are worked on in parallel, and the state
of the batches before, one small row per key, is added.  New state and new rows are published together
in a commit log, so a replayed batch changes nothing and no key's rows are held in one task's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagstream.operators.blocks import carried, in_blocks
from tagstream.operators.thresholds import A0, B0, OUT, thresholds
from tagstream.session import dimension, maybe_broadcast
from tagstream.streaming.commits import CommitLog
from tagstream.streaming.feed import each_batch

TOTAL_KEYS = ["learner", "category"]
TOTAL_STATE = "learner string, category string, total long, n long"
TOTAL_OUT = "learner string, category string, question_id long, units long, total long, n long"
THRESHOLD_STATE = "tag_index int, a long, b long, last_q long, from_q long"
SCORED = "tag_index int, question_id long, score double, y int"


def _known(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in TOTAL_KEYS], F.col("total").alias("_total"), F.col("n").alias("_n"))


def _same_key() -> list:
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TOTAL_KEYS]


def running_totals_batch(batch: DataFrame, batch_id: int, log: CommitLog, bits: int | None = None) -> None:
    """T4 for one micro-batch (learner, category, question_id, units), in question order after the batches
    before it: total and count of units up to each row."""
    if log.read(batch_id) is not None:
        return
    spark = log.spark
    rows = batch.select(*TOTAL_KEYS, F.col("question_id").cast("long").alias("question_id"), F.col("units").cast("long").alias("units"))
    rows = in_blocks(rows, TOTAL_KEYS, ["question_id", "units"], "t4-rows", bits)
    sums = rows.groupBy(*TOTAL_KEYS, "block").agg(F.sum("units").alias("total"), F.count("*").alias("n"))
    before = log.read(batch_id - 1)
    state = spark.read.schema(TOTAL_STATE).parquet(before["state"]) if before else spark.createDataFrame([], TOTAL_STATE)
    entry = carried(sums, TOTAL_KEYS, ["total", "n"]).join(_known(state), _same_key(), "left")
    entry = entry.select(*[F.col(c).alias(f"_{c}") for c in TOTAL_KEYS], F.col("block").alias("_block"),
                         (F.col("total") + F.coalesce("_total", F.lit(0))).alias("_total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("_n"))
    upto = Window.partitionBy(*TOTAL_KEYS, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({"total": F.coalesce(F.sum("units").over(upto), F.lit(0)), "n": F.count("*").over(upto)})
    out = local.join(entry, [*_same_key(), F.col("block") == F.col("_block")])
    out = out.select(*TOTAL_KEYS, "question_id", "units", (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
    mine = sums.groupBy(*TOTAL_KEYS).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = state.unionByName(mine).groupBy(*TOTAL_KEYS).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    record = {"out": log.folder("out", batch_id), "state": log.folder("state", batch_id)}
    out.write.parquet(record["out"])
    after.write.parquet(record["state"])
    log.publish(batch_id, record)


def thresholds_batch(batch: DataFrame, batch_id: int, log: CommitLog, bits: int | None = None) -> None:
    """T5 for one micro-batch (tag_index, question_id, score, y): thresholds in front of its rows.

    State is kept per (label, batch): a, b and the last question they cover.  A label whose rows come late,
    at or before a question that is done, goes back to its last state in front of them and is replayed from there; the
    replayed rows replace the earlier ones of that label."""
    if log.read(batch_id) is not None:
        return
    rows = batch.select("tag_index", F.col("question_id").cast("long").alias("question_id"), F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"))
    record = {"rows": log.folder("rows", batch_id), "out": log.folder("out", batch_id), "state": log.folder("state", batch_id)}
    rows.dropna(subset=["tag_index", "question_id", "score", "y"]).write.parquet(record["rows"])
    rows = log.spark.read.schema(SCORED).parquet(record["rows"])

    firsts = rows.groupBy("tag_index").agg(F.min("question_id").alias("first_q"))
    states = _valid_states(log, batch_id).join(firsts, "tag_index").filter(F.col("last_q") < F.col("first_q"))
    entry = states.groupBy("tag_index").agg(F.max_by(F.struct("a", "b", "last_q"), "batch").alias("s")).select("tag_index", "s.a", "s.b", F.col("s.last_q").alias("from_q"))
    since = firsts.join(entry, "tag_index", "left").select("tag_index", "a", "b", F.coalesce(F.col("from_q") + 1, F.lit(-2**63)).alias("from_q"))
    since = dimension(since, "t5-since")  # a row for each label of the batch: it is what a join may broadcast, not the rows
    old = log.table("rows", SCORED, batch_id).drop("batch").join(maybe_broadcast(since.select("tag_index", "from_q")), "tag_index").filter(F.col("question_id") >= F.col("from_q")).drop("from_q")
    known = since.filter("a is not null").select("tag_index", "a", "b")
    thresholds(rows.unionByName(old), known, bits).write.parquet(record["out"])
    done = log.spark.read.schema(OUT).parquet(record["out"])
    sums = done.groupBy("tag_index").agg(F.sum(F.col("y") * F.col("y_hat")).alias("da"), F.sum(F.col("y") + F.col("y_hat")).alias("db"), F.max("question_id").alias("last_q"))
    after = since.join(sums, "tag_index").select("tag_index", (F.coalesce("a", F.lit(A0)) + F.col("da")).cast("long").alias("a"), (F.coalesce("b", F.lit(B0)) + F.col("db")).cast("long").alias("b"), "last_q", "from_q")
    after.write.parquet(record["state"])
    log.publish(batch_id, record)


def _valid_states(log: CommitLog, upto: int) -> DataFrame:
    """States that no later batch has gone back behind."""
    states = log.table("state", THRESHOLD_STATE, upto)
    later = Window.partitionBy("tag_index").orderBy("batch").rowsBetween(1, Window.unboundedFollowing)
    return states.withColumn("_back", F.min("from_q").over(later)).filter(F.col("_back").isNull() | (F.col("_back") > F.col("last_q"))).drop("_back")


def threshold_rows(log: CommitLog) -> DataFrame:
    """The thresholds of all published batches; rows that a later batch replayed count once, as replayed."""
    out = log.table("out", OUT)
    back = log.table("state", THRESHOLD_STATE).select(F.col("tag_index").alias("_t"), F.col("batch").alias("_later"), "from_q").filter(F.col("_later") > 0)
    replayed = (F.col("tag_index") == F.col("_t")) & (F.col("_later") > F.col("batch")) & (F.col("question_id") >= F.col("from_q"))
    return out.join(back, replayed, "left_anti").drop("batch")


def carry(spark: SparkSession, feed_path: str, step: Callable[[DataFrame, int, CommitLog], None], root: str, checkpoint: str,
          chunks_per_trigger: int = 1):
    """Starts ``step`` over the micro-batches of a feed; its state and results are published under ``root``."""
    log = CommitLog(spark, root)
    return each_batch(spark, feed_path, lambda df, n: step(df, n, log), checkpoint, chunks_per_trigger)


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    return CommitLog(spark, root).table("out", TOTAL_OUT).drop("batch")
