"""Label tree arithmetic, training step, scoring against a brute-force computation, online
thresholds against a plain loop (M4–M6, M9, M14)."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagstream.operators import multilabel as ML
from tagstream.streaming.state import THRESHOLD_A0, THRESHOLD_B0, online_thresholds


def test_tree_seven_labels(spark):
    tags = spark.range(7).select(F.col("id").cast("int").alias("tag_index"))
    tree = {r.node: r for r in ML.label_tree(tags, 2).collect()}
    assert ML.n_internal(7, 2) == 6
    assert len(tree) == 13
    assert tree[1].parent == 0 and tree[2].parent == 0 and tree[0].parent is None
    assert [tree[n].tag_index for n in range(6, 13)] == list(range(7))
    assert tree[12].depth == 3 and tree[6].depth == 2


def test_tree_k3(spark):
    tags = spark.range(10).select(F.col("id").cast("int").alias("tag_index"))
    rows = ML.label_tree(tags, 3).collect()
    internal = ML.n_internal(10, 3)
    assert internal == 5 and len(rows) == 15
    for r in rows:
        if r.node:
            assert r.parent == (r.node - 1) // 3


def _brute_scores(feats: pd.DataFrame, w: pd.DataFrame, m: int, k: int = 2):
    internal = ML.n_internal(m, k)
    W = {(int(a), int(b)): v for a, b, v in w[["node", "bucket", "w"]].itertuples(index=False)}
    out = {}
    for q, g in feats.groupby("question_id"):
        x = dict(zip(g.bucket.astype(int), g.value.astype(float)))
        x[-1] = 1.0

        def p(node):
            z = sum(W.get((node, b), 0.0) * v for b, v in x.items())
            return 0.0 if z < -700 else 1.0 / (1.0 + math.exp(-z))

        for lab in range(m):
            n, prob = internal + lab, 1.0
            while True:
                prob *= p(n)
                if n == 0:
                    break
                n = (n - 1) // k
            out[(int(q), lab)] = prob
    return out


def test_train_and_score_match_brute_force(spark, fx):
    from tagstream.plans import q_tree

    tree = ML.label_tree(fx.tag, 2)
    labels = q_tree._labels(fx)
    feats = ML.hash_features(
        __import__("tagstream.operators.aggregates", fromlist=["x"]).term_frequencies(fx.question, "title"), 64)
    ex = ML.node_examples(labels, fx.question, tree, 2)
    w = ML.train_nodes(ex, feats, fx.question, epochs=2)
    got = {(r.question_id, r.tag_index): r.prob for r in ML.score_labels(fx.question, feats, w, tree, 2).collect()}
    m = fx.tag.count()
    want = _brute_scores(feats.toPandas(), w.toPandas(), m)
    qs = {r[0] for r in fx.question.select("question_id").collect()}
    assert set(got) == {(q, lab) for q in qs for lab in range(m)}
    for key, v in want.items():
        assert abs(got[key] - v) < 1e-9, key


def test_node_examples_reach_rule(spark):
    tags = spark.range(4).select(F.col("id").cast("int").alias("tag_index"))
    tree = ML.label_tree(tags, 2)  # internal 3: nodes 0..6, leaves 3..6
    qt = spark.createDataFrame([(1, 0), (1, 3), (2, 1)], "question_id long, tag_index int")
    qs = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    ex = {(r.question_id, r.node): r.y for r in ML.node_examples(qt, qs, tree, 2).collect()}
    # q1: labels at leaves 3 and 6 → positive path 3,1,0 and 6,2,0; children of 0,1,2 reached
    assert ex == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 0, (1, 5): 0, (1, 6): 1,
                  (2, 0): 1, (2, 1): 1, (2, 2): 0, (2, 3): 0, (2, 4): 1, (3, 0): 0}


def test_online_thresholds_match_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(lab), int(q), float(rng.random()), int(rng.random() < 0.3)) for lab in range(3) for q in range(200)]
    df = spark.createDataFrame(rows, "tag_index int, question_id long, score double, y int")
    got = {(r.tag_index, r.question_id): (r.threshold, r.y_hat) for r in online_thresholds(df, 2).collect()}
    for lab in range(3):
        a, b = THRESHOLD_A0, THRESHOLD_B0
        for (l2, q, s, y) in sorted(r for r in rows if r[0] == lab):
            t = a / b
            h = 1 if s >= t else 0
            assert got[(lab, q)] == (t, h)
            a += y * h
            b += y + h
