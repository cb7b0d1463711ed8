"""Order and completeness: the feed's replay order, keys over several Arrow batches, replayed batches, large chosen sets."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagstream.operators import aggregates as A
from tagstream.operators import multilabel as ML
from tagstream.operators import quality as Q
from tagstream.operators import relational as R
from tagstream.plans import q_tree
from tagstream.streaming import jobs as J
from tagstream.streaming import prequential as P
from tagstream.streaming.state import RunningTotalProcessor, ThresholdProcessor, threshold_steps


class _State:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _Handle:
    def getValueState(self, *_):
        return _State()


def test_feed_replays_in_order(spark, tmpdir_fresh):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1200).select(F.col("id").alias("question_id"))
        path = os.path.join(tmpdir_fresh, "feed")
        J.write_feed(df, path, 100)
        seen = []
        s = J.feed(spark, path, "question_id long, chunk_no long")
        J.drained(s.writeStream.option("checkpointLocation", os.path.join(tmpdir_fresh, "mark"))
                  .foreachBatch(lambda b, _: seen.append(sorted(r.question_id for r in b.collect()))).start())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert seen == [list(range(k, k + 100)) for k in range(0, 1200, 100)]


def test_running_totals_over_several_arrow_batches():
    p = RunningTotalProcessor()
    p.init(_Handle())
    part = lambda ids: pd.DataFrame({"learner": "a", "category": "c", "question_id": ids, "units": 1})
    out = pd.concat(p.handleInputRows(None, iter([part([5, 6, 7, 8]), part([1, 2, 3, 4])]), None))
    assert dict(zip(out["question_id"], out["total"])) == {k: k for k in range(1, 9)}


def test_thresholds_over_several_arrow_batches():
    p = ThresholdProcessor()
    p.init(_Handle())
    d = pd.DataFrame({"tag_index": 0, "question_id": range(8), "score": [0.9, 0.1, 0.6, 0.4, 0.7, 0.2, 0.8, 0.5], "y": [1, 0, 1, 0, 0, 1, 1, 0]})
    out = pd.concat(p.handleInputRows(None, iter([d[4:], d[:4]]), None))
    want = threshold_steps(d["score"].to_numpy(), d["y"].to_numpy(dtype=float), 1.0, 2.0)[0]
    assert list(out["question_id"]) == list(range(8)) and list(out["threshold"]) == list(want)


def test_replayed_batch_logs_its_rows_once(spark, fx, tmpdir_fresh):
    batch = fx.question.join(fx.feature_text, "question_id").filter("question_id < 40")
    labels, tree = q_tree._labels(fx), ML.label_tree(fx.tag, 2)
    model, log = os.path.join(tmpdir_fresh, "model"), os.path.join(tmpdir_fresh, "log")
    with pytest.raises(FileNotFoundError):
        P.prequential_step(batch, labels, tree, model, log, "PLT", 3, hd=64)
    for _ in range(2):
        P.prequential_step(batch, labels, tree, model, log, "PLT", 0, hd=64)
    assert P.read_log(spark, log).count() == 4 * batch.count()


def test_chosen_sets_have_no_cap(spark):
    qt = spark.range(30).select(F.col("id").alias("question_id"), F.explode(F.sequence(F.lit(0), F.col("id") * 3)).alias("t"))
    qt = qt.select("question_id", F.format_string("t%03d", "t").alias("tag"))
    names = qt.select("tag").distinct()
    assert names.count() == 88
    got = {(r.tag1, r.tag2): r.n for r in A.cooccurrence(qt, names).collect()}
    assert len(got) == 88 * 87 // 2
    assert got["t000", "t001"] == 29 and got["t086", "t087"] == 1
    assert R.tag_pairs(qt, names).count() == sum((3 * k + 1) * 3 * k // 2 for k in range(30))


def test_thresholds_of_real_scores(spark):
    rows = [(k % 3, k * 0.37 % 1, int(k * 7 % 5 < 2)) for k in range(200)] + [(None, 0.5, 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "tag_index int, score double, y int")
    got = {r.tag_index: (r.threshold, r.best_f) for r in Q.tune_thresholds(df).collect()}
    for label in (0, 1, 2, None):
        own = [(s, y) for t, s, y in rows if t == label]
        pos = sum(y for _, y in own)
        cuts = sorted({s for s, _ in own if s is not None})
        best = max((2 * sum(y for s, y in own if s is not None and s >= c) / (sum(s is not None and s >= c for s, _ in own) + pos), c) for c in cuts)
        assert got[label] == (best[1], best[0])
