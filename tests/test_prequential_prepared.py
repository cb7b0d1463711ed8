"""M17 over a table: what no batch changes is made once, with the rows that steps on texts give."""

import os

import pytest
from pyspark.sql import functions as F

from tagstream.operators import multilabel as ML
from tagstream.plans import q_tree
from tagstream.streaming import prequential as P
from tagstream.streaming.commits import CommitLog


def test_replay_prepares_once(spark, fx, tmpdir_fresh, monkeypatch):
    tree, labels = ML.label_tree(fx.tag, 2), q_tree._labels(fx)
    questions = fx.question.join(fx.feature_text, "question_id").filter("question_id % 3 <> 0").select("question_id", "text", "created_on")
    calls, make = [], P.A.term_frequencies
    monkeypatch.setattr(P.A, "term_frequencies", lambda *a, **k: (calls.append(1), make(*a, **k))[1])
    log = P.prequential_replay(questions, labels, tree, os.path.join(tmpdir_fresh, "replay"), "PLT", 70, hd=64)
    got = sorted(map(str, log.collect()))
    assert len(calls) == 1
    ids = sorted(r.question_id for r in questions.select("question_id").collect())
    model, rows = os.path.join(tmpdir_fresh, "model"), os.path.join(tmpdir_fresh, "rows")
    for n in range(0, len(ids), 70):
        P.prequential_step(questions.filter(F.col("question_id").isin(ids[n:n + 70])), labels, tree, model, rows, "PLT", n // 70, hd=64)
    assert got == sorted(map(str, P.read_log(spark, rows).collect())) and len(got) == 4 * len(ids)


def _parts(fx):
    questions = fx.question.join(fx.feature_text, "question_id").filter("question_id < 90").select("question_id", "text", "created_on")
    return questions, q_tree._labels(fx), ML.label_tree(fx.tag, 2)


def _weights(df):
    return {(r.node, r.bucket): r.w for r in df.collect()}


def test_small_batches_share_a_micro_batch(spark, fx, tmpdir_fresh, monkeypatch):
    questions, labels, tree = _parts(fx)
    calls, make = [], P.packed.sequence
    monkeypatch.setattr(P.packed, "sequence", lambda *a, **k: (calls.append(1), make(*a, **k))[1])
    root, publish, lost = os.path.join(tmpdir_fresh, "replay"), CommitLog.publish, []

    def fails(self, n, record):
        if "log" in record and n == 1 and not lost:
            lost.append(n)
            raise RuntimeError("lost")
        return publish(self, n, record)

    monkeypatch.setattr(CommitLog, "publish", fails)
    with pytest.raises(Exception, match="lost"):
        P.prequential_replay(questions, labels, tree, root, "PLT", 30, hd=64)
    assert len(calls) == 1 and P.read_log(spark, os.path.join(root, "log")).count() == 4 * 30  # only the first batch is published
    got = sorted(map(str, P.prequential_replay(questions, labels, tree, root, "PLT", 30, hd=64).collect()))
    model, rows = os.path.join(tmpdir_fresh, "model"), os.path.join(tmpdir_fresh, "rows")
    for n in range(3):
        P.prequential_step(questions.filter(F.col("question_id").between(30 * n, 30 * n + 29)), labels, tree, model, rows, "PLT", n, hd=64)
        a, b = _weights(P.read_model(spark, os.path.join(root, "log"), n)), _weights(P.read_model(spark, rows, n))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert got == sorted(map(str, P.read_log(spark, rows).collect())) and len(got) == 4 * 90


def test_large_batches_stay_spread(spark, fx, tmpdir_fresh, monkeypatch):
    questions, labels, tree = _parts(fx)
    near = P.prequential_replay(questions, labels, tree, os.path.join(tmpdir_fresh, "near"), "PLT", 45, hd=64)
    monkeypatch.setattr(P.packed, "BATCH_BYTES", 0)
    monkeypatch.setattr(P.packed, "sequence", None)
    far = P.prequential_replay(questions, labels, tree, os.path.join(tmpdir_fresh, "far"), "PLT", 45, hd=64)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())) and near.count() == 4 * 90
