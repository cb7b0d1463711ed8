"""Packed training and best-first scoring against the long forms, with blocks of any size."""

import math

import numpy as np
from pyspark.sql import functions as F

from tagstream.operators import multilabel as ML
from tagstream.operators import packed as PK


def _parts(spark, tags=7, questions=40):
    tree = ML.label_tree(spark.range(tags).select(F.col("id").cast("int").alias("tag_index")), 2)
    qs = spark.range(questions).select(F.col("id").alias("question_id"))
    feats = qs.filter("question_id % 5 <> 0").select("question_id", F.explode(F.sequence(F.lit(0), F.col("question_id") % 6)).alias("b"))
    feats = feats.select("question_id", ((F.col("b") * 7 + F.col("question_id")) % 16).cast("int").alias("bucket"), (F.col("b") % 3 + 1).cast("bigint").alias("value"))
    labels = qs.filter("question_id % 4 <> 1").select("question_id", (F.col("question_id") * 3 % tags).cast("int").alias("tag_index"))
    return tree, qs, feats, ML.node_examples(labels, qs, tree, 2)


def _weights(df):
    return {(r.node, r.bucket): r.w for r in df.collect()}


def test_steps_equal_the_long_form_in_any_blocks(spark):
    tree, qs, feats, ex = _parts(spark)
    rows, n_node = PK.pack(feats, qs, ex), ML.node_counts(ex)
    width = PK.width_of(rows)
    matrix = ML.train_matrix(ex, ML.with_bias(feats, qs), materialize=False)
    long = packed = None
    for rate in (1.0, 0.5, 0.3):
        long = ML.gradient_step(matrix, n_node, long if long is not None else ML.empty_weights(spark), 0, rate).checkpoint()
        packed = PK.step(rows, n_node, packed, 13, rate, width, limit=8 * width * 3).checkpoint()  # three nodes a block
        a, b = _weights(long), _weights(packed)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert PK.blocks_of(13, width, 8 * width * 3) == [(0, 3), (3, 6), (6, 9), (9, 12), (12, 13)]


def test_search_equals_every_score(spark):
    tags, top, low = 9, 3, 0.25
    tree = ML.label_tree(spark.range(tags).select(F.col("id").cast("int").alias("tag_index")), 2)
    internal, total, _ = ML.tree_params(tree)
    qs = spark.range(8).select(F.col("id").alias("question_id"))
    feats = qs.filter("question_id > 0").select("question_id", F.lit(1).alias("bucket"), (F.col("question_id") / 3 + 0.5).alias("value"))
    weights = spark.createDataFrame([(n, b, math.sin(n * 7.0 + b) * 3) for n in range(total) for b in (-1, 1, 4)], "node long, bucket int, w double")
    rows = PK.pack(feats, qs)
    got = {(r.question_id, r.tag_index): r.prob for r in PK.search_labels(rows, weights, internal, total, 2, top, low, PK.width_of(rows, weights)).collect()}
    every = {}
    for r in ML.score_labels(qs, feats, weights, tree).collect():
        every.setdefault(r.question_id, []).append((r.prob, r.tag_index))
    want = {}
    for q, found in every.items():
        best = sorted(found, key=lambda x: (-x[0], x[1]))
        want.update({(q, t): p for p, t in best[:top]})
        want.update({(q, t): p for p, t in best if p >= low})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not PK.fits(total, 10, 8 * 10 * total - 1) and PK.fits(total, 10, 8 * 10 * total)


def test_large_trees_fall_back_to_levels(spark, monkeypatch):
    tree, qs, feats, ex = _parts(spark)
    w = ML.train_nodes(ex, feats, qs, epochs=2)

    def best():
        return {(r.question_id, r.tag_index) for r in ML.predict(qs, feats, w, tree, spark.range(7).select(F.col("id").cast("int").alias("tag_index"), F.col("id").cast("string").alias("name")), 2, k=2)
                .select("question_id", F.explode("topk").alias("tag_index")).collect()}

    near = best()
    monkeypatch.setattr(PK, "BLOCK_BYTES", 8)
    assert best() == near and len(near) == 80


def test_nothing_to_train_on(spark):
    tree, qs, feats, ex = _parts(spark)
    assert ML.train_nodes(ex.limit(0), feats, qs, epochs=2).count() == 0


def test_a_step_shuffles_sums_not_a_row_a_weight_and_task(spark):
    tree, qs, feats, ex = _parts(spark, questions=200)
    rows, n_node = PK.pack(feats, qs, ex).repartition(16), ML.node_counts(ex)
    width = PK.width_of(rows)
    sums = rows.select("buckets", "values", "nodes", "ys").mapInArrow(PK._stacked, ", ".join(f"{c} binary" for c in PK.STACKED)).mapInArrow(
        PK._gradients(None, 0, 13, width), "start long, chunk int, gw binary, touched binary")
    assert sums.count() == 16  # one row a task for this many weights
    a, b = _weights(PK.step(rows, n_node, None, 13, 1.0, width)), _weights(PK.step(PK.stack(rows), n_node, None, 13, 1.0, width))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_a_sequence_of_batches_takes_the_steps_one_by_one(spark):
    tree, qs, feats, ex = _parts(spark)
    rows = PK.pack(feats, qs, ex).withColumn("chunk_no", (F.col("question_id") / 15).cast("long"))
    rows = rows.union(rows.filter("question_id = 3"))  # a repeated question counts once
    width = PK.width_of(rows)

    def rate(number, epoch):
        return 1.0 / (1.0 + number * 2 + epoch)

    found = PK.sequence(rows, PK.held_weights(None, 13, width), rate, 2).cache()
    w, before = None, {}
    for n in range(3):
        mine = rows.filter(F.col("chunk_no") == n).dropDuplicates(["question_id"])
        counts = mine.select("question_id", F.explode("nodes").alias("node")).transform(ML.node_counts)
        before[n] = w
        for t in range(2):
            w = PK.step(mine, counts, w if w is not None else ML.empty_weights(spark), 13, rate(n, t), width).checkpoint()
    a, b = _weights(w), _weights(PK.last_weights(found, width))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    stacks = PK.margins_of(found)
    for n, model in before.items():
        want = PK.search_labels(rows.filter(F.col("chunk_no") == n).dropDuplicates(["question_id"]), model if model is not None else ML.empty_weights(spark), 6, 13, 2, 3, 0.3, width)
        got = PK.best_labels(stacks.filter(F.col("chunk_no") == n), "pre", 6, 13, 2, 3, 0.3)
        want, got = ({(r.question_id, r.tag_index): r.prob for r in x.collect()} for x in (want, got))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_stacks_hold_neighbours_and_later_epochs_mark_nothing(spark):
    tree, qs, feats, ex = _parts(spark, questions=600)
    rows, n_node = PK.pack(feats, qs, ex).repartition(1), ML.node_counts(ex)
    width, stacked = PK.width_of(rows), PK.stack(rows)
    reached = []
    for batch in stacked.toArrow().to_batches():
        for of_b, of_n, b, v, n, y in PK._stacks(batch):
            reached += [tuple(x) for x in np.split(n, np.cumsum(of_n)[:-1])]
            for q, mine in PK._reached(of_n, n, y, 0, 13):
                own, values, size = PK._part(q, of_b, b, v)
                at = np.concatenate([np.arange(len(b))[o - s:o] for o, s in zip(np.cumsum(of_b)[q], of_b[q])])
                assert list(own) == list(b[at]) and list(values) == list(v[at]) and list(size) == list(of_b[q])
    assert len(reached) == 600 and reached == sorted(reached)
    w = PK.step(stacked, n_node, None, 13, 1.0, width).checkpoint()
    a, b = _weights(PK.step(stacked, n_node, w, 13, 0.5, width)), _weights(PK.step(stacked, n_node, w, 13, 0.5, width, seen=True))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_stop_words_are_a_set(spark):
    from tagstream.functions import text as TX

    df = spark.createDataFrame([(["the", "cat", "and", "cat", ""],), ([],), (None,)], "t array<string>").select(TX.drop_stop("t").alias("t"))
    assert [r.t for r in df.collect()] == [["cat", "cat", ""], [], None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
