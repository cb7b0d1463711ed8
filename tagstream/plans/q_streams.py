"""Stream forms (T1, T3–T8) as registered queries: available-now streams over the tables, which are
laid out in the shared scratch folder, with Parquet results there."""

from pyspark.sql import functions as F

from tagstream.operators import windows as W
from tagstream.plans.q_tree import THRESHOLD_SQL, scored_labels
from tagstream.plans.registry import query
from tagstream.session import scratch_path
from tagstream.streaming import carried as C
from tagstream.streaming import jobs as J
from tagstream.streaming.commits import CommitLog


def _source(fx, df, name: str):
    """A stream over the rows of ``df``, written as files first."""
    path = scratch_path(fx.spark, name)
    df.write.parquet(path)
    return fx.spark.readStream.schema(df.schema).parquet(path)


def _appended(fx, stream, name: str):
    """The rows that the stream has appended by its end."""
    out, mark = scratch_path(fx.spark, name), scratch_path(fx.spark, f"{name}-mark")
    stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(out)


def _complete(fx, stream, name: str):
    """The last result of a stream of aggregates: each trigger overwrites the table."""
    out, mark = scratch_path(fx.spark, name), scratch_path(fx.spark, f"{name}-mark")
    (stream.writeStream.outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True)
     .foreachBatch(lambda df, _id: df.write.mode("overwrite").parquet(out)).start().awaitTermination())
    return fx.spark.read.schema(stream.schema).parquet(out)


#: Micro-batches that the queries cut their tables into.
FEED_BATCHES = 4


def _fed(fx, df, name: str) -> str:
    """An ordered feed of ``df`` by question in ``FEED_BATCHES`` chunks."""
    path = scratch_path(fx.spark, f"{name}-feed")
    J.write_feed(df, path, max(1, -(-df.count() // FEED_BATCHES)))
    return path


def _carried(fx, df, step, name: str) -> str:
    """The folder of what ``step`` has published over the feed of ``df``."""
    root, mark = scratch_path(fx.spark, name), scratch_path(fx.spark, f"{name}-mark")
    J.drained(C.carry(fx.spark, _fed(fx, df, name), step, root, mark))
    return root


@query("t1_feed_stream", """
select question_id, title, row_no, row_no // ((count(*) over () + 3) // 4) as batch_no
from (select question_id, title, row_number() over (order by question_id) - 1 as row_no from fx_question) x""")
def t1_feed_stream(fx):
    """Every question with its place in the feed and the micro-batch that brought it."""
    root, mark = scratch_path(fx.spark, "t1-out"), scratch_path(fx.spark, "t1-mark")
    log = CommitLog(fx.spark, root)

    def took(df, n):
        out = log.folder("out", n)
        df.select("question_id", "title", "row_no").write.parquet(out)
        log.publish(n, {"out": out})

    J.drained(J.each_batch(fx.spark, _fed(fx, fx.question.select("question_id", "title"), "t1"), took, mark))
    return log.table("out", "question_id long, title string, row_no long").withColumnRenamed("batch", "batch_no")


@query("t3_running_avg_stream", """
select learner, is_prequential, is_topk, avg(units) / cast(50000 as double) as avg_f, count(*) as n
from fx_log where is_test = 0 group by learner, is_prequential, is_topk""")
def t3_running_avg_stream(fx):
    return _complete(fx, J.running_avg_stream(_source(fx, fx.log, "t3-in")), "t3-out")


@query("t4_running_total_stream", """
select learner, category, question_id, units,
       cast(sum(units) over (partition by learner, category order by question_id) as bigint) as total,
       count(*) over (partition by learner, category order by question_id) as n
from (select learner, question_id, units,
        concat(case when is_prequential = 1 then 'prequential' else 'post-training' end, ' ',
               case when is_topk = 1 then 'topk' else 'general' end) as category
      from fx_log where is_test = 0) x""")
def t4_running_total_stream(fx):
    """T4 (X2): totals carried from micro-batch to micro-batch of an ordered feed, in blocks inside each."""
    long = W.melt_long(fx.result).select("learner", "category", "question_id", "units")
    return C.read_totals(fx.spark, _carried(fx, long, C.running_totals_batch, "t4"))


@query("t5_threshold_stream", THRESHOLD_SQL)
def t5_threshold_stream(fx):
    """T5 (X3): thresholds over an ordered feed of scored rows, with a state per label and micro-batch."""
    root = _carried(fx, scored_labels(fx), C.thresholds_batch, "t5")
    return C.threshold_rows(CommitLog(fx.spark, root))


@query("t6_vocabulary_stream", """
select cast(row_number() over (order by name) - 1 as int) as index, name
from (select distinct tag as name from fx_question_tag) t""")
def t6_vocabulary_stream(fx):
    """The vocabulary that the stream of tag names leaves (one trigger, so in name order)."""
    vocab, mark = scratch_path(fx.spark, "t6-vocab"), scratch_path(fx.spark, "t6-mark")
    names = _source(fx, fx.question_tag.select(F.col("tag").alias("name")), "t6-in")
    J.upkeep_vocab(names, vocab, mark, available_now=True).awaitTermination()
    return fx.spark.read.schema("index int, name string").parquet(vocab)


@query("t7_dedupe_stream", "select question_id, title from fx_question")
def t7_dedupe_stream(fx):
    """Questions with a label arrive twice, one second apart; each is let through once."""
    q = fx.question.select("question_id", "title", "created_on")
    again = q.join(fx.t.labels.select(F.col("doc_id").alias("question_id")), "question_id", "left_semi").withColumn(
        "created_on", F.col("created_on") + F.expr("INTERVAL 1 SECOND"))
    s = J.dedupe_stream(_source(fx, q.unionByName(again), "t7-in"), "question_id", "created_on")
    return _appended(fx, s, "t7-out").select("question_id", "title")


@query("t8_daily_counts_stream", """
select date_trunc('day', created_on) as day_start, date_trunc('day', created_on) + interval 1 day as day_end, count(*) as n
from fx_question group by date_trunc('day', created_on)""")
def t8_daily_counts_stream(fx):
    s = J.daily_counts_stream(_source(fx, fx.question.select("question_id", "created_on"), "t8-in"), "created_on")
    return _complete(fx, s, "t8-out").select(F.col("day_start").cast("timestamp_ntz").alias("day_start"),
                                             F.col("day_end").cast("timestamp_ntz").alias("day_end"), "n")
