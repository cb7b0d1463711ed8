"""Structured Streaming jobs.

The online loop of the reference — take the next questions, score them, train on them, log both
evaluations — becomes an ordered feed (``feed.py``) of question batches processed by
``foreachBatch``; every piece of state (vocabulary, model weights, metric log) is a table in the
shared checkpoint folder, and the stream's own checkpoint makes it resumable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.streaming.feed import drained, each_batch, feed, write_feed  # noqa: F401  (T1)


def running_avg_stream(events: DataFrame) -> DataFrame:
    """Running averages per learner, phase and kind (update mode)."""
    return (events.filter(F.col("is_test") == 0).groupBy("learner", "is_prequential", "is_topk")
            .agg((F.avg("units") / F.lit(50000.0)).alias("avg_f"), F.count(F.lit(1)).alias("n")))


def dedupe_stream(events: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated external ids within the watermark delay (overlapping slices)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_counts_stream(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Arrivals per UTC day; a day is final once the watermark passes its end."""
    t = F.col(ts).cast("timestamp")
    return (events.withColumn(ts, t).withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "n"))


def upkeep_vocab_batch(batch: DataFrame, vocab_path: str, name_col: str = "name") -> DataFrame:
    """T6 step for one micro-batch: names not yet in the vocabulary are appended with the next
    indices; stored indices never change.  Returns the rows appended."""
    from tagstream.operators.indexing import assign_index
    from tagstream.operators.relational import names_minus

    spark = batch.sparkSession
    names = batch.select(F.col(name_col).alias("name"))
    if _exists(spark, vocab_path):
        vocab = spark.read.parquet(vocab_path)
    else:
        vocab = spark.createDataFrame([], "index int, name string")
    new = names_minus(names, vocab, "name")
    start = vocab.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    added = assign_index(new, "name", int(start), out="index").select(F.col("index").cast("int"), "name")
    added = added.checkpoint(eager=True)  # the append must not re-read the vocabulary it extends
    added.write.mode("append").parquet(vocab_path)
    return added


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def upkeep_vocab(stream: DataFrame, vocab_path: str, checkpoint: str, name_col: str = "name", available_now: bool = False):
    """Keep the vocabulary current as batches arrive (``foreachBatch`` + J8)."""
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return (w.foreachBatch(lambda df, _id: upkeep_vocab_batch(df, vocab_path, name_col)).start())
