"""Stream forms give the same final tables as their batch twins."""

import os

from pyspark.sql import functions as F

from tagstream.operators import windows as W
from tagstream.operators.aggregates import running_avg
from tagstream.streaming import jobs as J
from tagstream.streaming.state import online_thresholds, running_total, threshold_stream


def _run(stream_df, spark, name, mode="append"):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def _feed(spark, df, root, size, order="question_id"):
    path = os.path.join(root, "feed")
    J.write_feed(df, path, size, order)
    return J.feed(spark, path, spark.read.parquet(path).schema)


def test_running_total_stream_equals_batch(spark, fx, tmpdir_fresh):
    long = W.melt_long(fx.result).select("learner", "category", "question_id", "units")
    s = _feed(spark, long, tmpdir_fresh, 500)
    out = _run(running_total(s.drop("chunk_no")), spark, "t4_out")
    final = {(r.learner, r.category): (r.total, r.n) for r in
             out.groupBy("learner", "category").agg(F.max("total").alias("total"), F.max("n").alias("n")).collect()}
    want = {(r.learner, r.category): (r.t, r.n) for r in
            long.groupBy("learner", "category").agg(F.sum("units").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert final == want
    # the running total of the last question equals the batch window's cumulative sum
    batch = W.cumulative_f(long, "units", order=("question_id",)).select("learner", "category", "question_id", "cum_f")
    j = out.join(batch, ["learner", "category", "question_id"])
    assert j.filter(F.col("total") != F.col("cum_f")).count() == 0
    assert j.count() == long.count()


def test_threshold_stream_equals_batch(spark, fx, tmpdir_fresh):
    s = fx.label_score.select("tag_index", "question_id", (F.col("score_milli") / 1000.0).alias("score"),
                              (F.col("score_milli") % 3 == 0).cast("int").alias("y"))
    st = _feed(spark, s, tmpdir_fresh, 1000)
    got = _run(threshold_stream(st.drop("chunk_no")), spark, "t5_out")
    want = online_thresholds(s)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_running_avg_stream(spark, fx, tmpdir_fresh):
    s = _feed(spark, fx.log, tmpdir_fresh, 2000)
    got = _run(J.running_avg_stream(s), spark, "t3_out", mode="complete")
    want = running_avg(fx.log)
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_dedupe_and_daily_counts_stream(spark, fx, tmpdir_fresh):
    q = fx.question.select("question_id", "created_on")
    twice = q.unionByName(q)
    s = _feed(spark, twice, tmpdir_fresh, 200, order="question_id")
    got = _run(J.dedupe_stream(s.drop("chunk_no"), "question_id", "created_on"), spark, "t7_out")
    assert got.count() == q.count()


def test_vocab_upkeep_keeps_indices(spark, fx, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "vocab")
    names = fx.question_tag.select(F.col("tag").alias("name"))
    J.upkeep_vocab_batch(names.filter(F.col("name").startswith("lang:")), path)
    first = {r["name"]: r["index"] for r in spark.read.parquet(path).collect()}
    J.upkeep_vocab_batch(names, path)
    J.upkeep_vocab_batch(names, path)  # a replayed batch adds nothing
    after = {r["name"]: r["index"] for r in spark.read.parquet(path).collect()}
    assert all(after[k] == v for k, v in first.items())
    assert sorted(after.values()) == list(range(len(after)))
    assert set(after) == {r.name for r in names.distinct().collect()}


def test_prequential_rows(spark, fx, tmpdir_fresh):
    from tagstream.operators import multilabel as ML
    from tagstream.plans import q_tree
    from tagstream.streaming.prequential import prequential_replay

    tree = ML.label_tree(fx.tag, 2)
    log = prequential_replay(fx.question.join(fx.feature_text, "question_id"), q_tree._labels(fx), tree, tmpdir_fresh, "PLT", 100, hd=256)
    n = fx.question.count()
    assert log.count() == 4 * n
    assert log.groupBy("is_prequential", "is_topk").count().count() == 4
    assert log.filter((F.col("units") < 0) | (F.col("units") > 50000)).count() == 0


def test_daily_counts_stream_equals_batch(spark, fx, tmpdir_fresh):
    from tagstream.streaming.ops import daily_counts

    q = fx.question.select("question_id", "created_on")
    s = _feed(spark, q, tmpdir_fresh, 100)
    got = _run(J.daily_counts_stream(s.drop("chunk_no"), "created_on"), spark, "t8_out", mode="update")
    final = {r.day_start.replace(tzinfo=None): r.n for r in
             got.groupBy("day_start").agg(F.max("n").alias("n")).collect()}
    want = {r.day_start: r.n for r in daily_counts(q, "created_on").collect()}
    assert final == want


def test_feed_resumes_from_checkpoint(spark, fx, tmpdir_fresh):
    """A restarted feed continues after the last committed batch (no loss, no repeats)."""
    q = fx.question.select("question_id", "title")
    first = q.filter(F.col("question_id") % 2 == 0)
    second = q.filter(F.col("question_id") % 2 == 1)
    feed_path = os.path.join(tmpdir_fresh, "feed")
    out, ckpt = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ckpt")

    def run_once():
        s = J.feed(spark, feed_path, spark.read.parquet(feed_path).schema)
        qry = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).start()
        qry.processAllAvailable()
        qry.stop()

    J.write_feed(first, feed_path, 100)
    run_once()
    J.write_feed(second, feed_path, 100)
    run_once()
    got = spark.read.parquet(out)
    assert got.count() == q.count()
    assert got.select("question_id").distinct().count() == q.count()
