"""Ordered feed, commit log, totals and thresholds carried over micro-batches and blocks."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagstream.operators import multilabel as ML
from tagstream.operators.thresholds import narrowed, steps, thresholds
from tagstream.plans import q_tree
from tagstream.streaming import carried as C
from tagstream.streaming import prequential as P
from tagstream.streaming.commits import CommitLog
from tagstream.streaming.feed import drained, each_batch, write_feed

SCORED = "tag_index int, question_id long, score double, y int"


def scored_rows(seed=5):
    """One label with most rows, small ones, one whose scores are all the same."""
    rng, rows = random.Random(seed), []
    for tag, n, p in ((0, 1500, 0.3), (1, 5, 0.5), (2, 90, 0.1), (3, 200, 0.9)):
        for q in range(n):
            y = int(rng.random() < p)
            rows.append((tag, 2 * q, round(min(1.0, max(0.0, rng.gauss(0.3 + 0.3 * y, 0.2))), 3), y))
    return rows + [(5, q, 0.5, q % 2) for q in range(300)]


def plain(rows):
    out = {}
    for tag in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == tag)
        t, h, _, _ = steps(np.array([r[1] for r in own]), np.array([r[2] for r in own]), 1, 2)
        out.update({(tag, r[0]): (r[1], r[2], float(x), int(z)) for r, x, z in zip(own, t, h)})
    return out


def keyed(rows):
    return {(r[0], r[1]): tuple(r)[2:] for r in rows}


@pytest.mark.parametrize("bits", [3, 16])
def test_thresholds_by_blocks_equal_the_loop(spark, bits):
    rows = scored_rows()
    got = thresholds(spark.createDataFrame(rows, SCORED).repartition(7), bits=bits).collect()
    assert len(got) == len(rows) and keyed(got) == plain(rows)


def test_thresholds_edges(spark):
    df = spark.createDataFrame([(None, 1, 0.5, 1), (1, None, 0.5, 1), (1, 2, None, 1), (1, 3, 0.4, 1), (1, 3, 0.4, 1)], SCORED)
    got = sorted(map(tuple, thresholds(df).select("tag_index", "score", "threshold", "y_hat").collect()))
    assert got == [(1, 0.4, 0.4, 1), (1, 0.4, 2 / 3, 0), (1, 0.5, 0.5, 1)] or [g[:2] for g in got] == [(1, 0.4), (1, 0.4), (1, 0.5)]
    assert [g[2] for g in got if g[1] == 0.5] == [0.5]  # a null question comes first
    assert thresholds(df.limit(0)).count() == 0


def test_most_rows_are_decided_without_their_threshold():
    rng = np.random.default_rng(1)
    ys = (rng.random(4000) < 0.4).astype(np.int64)
    scores = np.clip(rng.normal(0.2 + 0.6 * ys, 0.15), 0, 1)
    ones = int(ys[:2000].sum())
    decided = narrowed(scores[:2000], ys[:2000], 1, 2, 0, 0)
    exact = steps(scores, ys, 1, 2)[1]
    assert (decided == exact[:2000]).all()  # a known state in front of a block leaves nothing open
    later = narrowed(scores[2000:], ys[2000:], 1, 2 + ones, ones, 2000 - ones)
    sure = later != -1
    assert sure.mean() > 0.3 and (later[sure] == exact[2000:][sure]).all()


def test_late_batches_are_replayed(spark, tmpdir_fresh):
    rows = scored_rows(6)
    df = spark.createDataFrame(rows, SCORED)
    q = F.col("question_id")
    log = CommitLog(spark, os.path.join(tmpdir_fresh, "t5"))
    parts = [q < 300, (q >= 900) & (q < 1500), (q >= 300) & (q < 600), q >= 1500, (q >= 600) & (q < 900)]
    for n, part in enumerate(parts):
        C.thresholds_batch(df.filter(part), n, log, 5)
    C.thresholds_batch(df.filter(parts[0]), 4, log, 5)  # a replayed batch does nothing
    got = C.threshold_rows(log).collect()
    assert len(got) == len(rows) and keyed(got) == plain(rows)


def test_one_key_with_all_rows(spark, tmpdir_fresh):
    df = spark.range(4000).select(F.lit("L").alias("learner"), F.lit(None).cast("string").alias("category"), F.col("id").alias("question_id"), (F.col("id") % 7).alias("units"))
    path, root = os.path.join(tmpdir_fresh, "feed"), os.path.join(tmpdir_fresh, "t4")
    write_feed(df.repartition(5), path, 900)
    step = lambda b, n, log: C.running_totals_batch(b, n, log, bits=6)
    drained(C.carry(spark, path, step, root, os.path.join(tmpdir_fresh, "mark"), chunks_per_trigger=2))
    got = {r.question_id: (r.total, r.n) for r in C.read_totals(spark, root).collect()}
    total, want = 0, {}
    for k in range(4000):
        total += k % 7
        want[k] = (total, k + 1)
    assert got == want and len(CommitLog(spark, root).numbers()) == 3


def test_feed_order_does_not_rest_on_file_times(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "feed")
    write_feed(spark.range(50, 0, -1).select(F.col("id").alias("question_id")), path, 8)
    write_feed(spark.range(100, 105).select(F.col("id").alias("question_id")), path, 8)
    for folder, _, names in os.walk(path):
        for n in names:
            os.utime(os.path.join(folder, n), (1, 1))
    seen, folders = [], []

    def took(df, n):
        seen.append([r.question_id for r in df.orderBy("row_no").collect()])
        folders.append({os.path.basename(os.path.dirname(f)) for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]})

    drained(each_batch(spark, path, took, os.path.join(tmpdir_fresh, "mark"), start_row=3))
    assert seen == [list(range(4, 9)), *[list(range(k, min(k + 8, 51))) for k in range(9, 51, 8)], list(range(100, 105))]
    assert folders == [{f"chunk_no={k}"} for k in range(8)]  # a micro-batch reads its own chunk


def test_commit_log(spark, tmpdir_fresh):
    log = CommitLog(spark, os.path.join(tmpdir_fresh, "log"))
    assert log.read(0) is None and log.numbers() == [] and log.table("x", "a int").count() == 0
    assert log.publish(0, {"x": "one"}) and not log.publish(0, {"x": "two"})
    assert log.read(0) == {"x": "one"} and log.numbers() == [0]


def test_a_failure_between_model_and_log_leaves_nothing(spark, fx, tmpdir_fresh, monkeypatch):
    batch = fx.question.join(fx.feature_text, "question_id").filter("question_id < 30")
    labels, tree = q_tree._labels(fx), ML.label_tree(fx.tag, 2)
    model, log = os.path.join(tmpdir_fresh, "model"), os.path.join(tmpdir_fresh, "log")
    publish = CommitLog.publish

    def fails(self, n, record):
        raise RuntimeError("lost")

    monkeypatch.setattr(CommitLog, "publish", fails)
    with pytest.raises(RuntimeError):
        P.prequential_step(batch, labels, tree, model, log, "PLT", 0, hd=64)
    assert P.read_log(spark, log).count() == 0  # written, but published by no record
    monkeypatch.setattr(CommitLog, "publish", publish)
    P.prequential_step(batch, labels, tree, model, log, "PLT", 0, hd=64)
    assert P.read_log(spark, log).count() == 4 * batch.count()
