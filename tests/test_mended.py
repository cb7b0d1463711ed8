"""No row is dropped: null keys, deep chains, null versions, instances without attributes, complete top-k."""

import math
import os

from pyspark.sql import functions as F

from tagstream.operators import multilabel as ML
from tagstream.operators import relational as R
from tagstream.operators import windows as W
from tagstream.sources import files


def test_prefix_sums_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), (None, 1, 7), (None, 3, 1)], "k string, o int, x int")
    out = W.prefix_aggregate(df, ["k"], ["o"], "o", {"s": F.col("x")})
    assert sorted((str(r.k), r.o, r.s) for r in out.collect()) == [("None", 1, 7), ("None", 3, 8), ("a", 1, 10), ("a", 2, 15)]


def test_learner_tree_is_followed_to_its_end(spark):
    rows = [(0, None), *[(k, k - 1) for k in range(1, 71)], (100, 101), (101, 100)]
    df = spark.createDataFrame(rows, "learner_id int, parent_id int")
    tree = R.learner_tree(df)
    assert tree.count() == 71 and tree.agg(F.max("depth")).first()[0] == 70
    assert sorted(r.learner_id for r in R.unreached_learners(df, tree).collect()) == [100, 101]


def test_upsert_with_null_and_equal_versions(spark):
    base = spark.createDataFrame([(1, None, "x"), (2, 1, "a")], "id int, v int, s string")
    delta = spark.createDataFrame([(2, 1, "b"), (3, None, "y"), (3, 2, "z")], "id int, v int, s string")
    assert sorted(map(tuple, R.upsert(base, delta, "id", "v").collect())) == [(1, None, "x"), (2, 1, "b"), (3, 2, "z")]


def test_instance_with_only_an_id_is_kept(spark, tmpdir_fresh):
    with open(os.path.join(tmpdir_fresh, "a.arff"), "w") as f:
        f.write("@relation r\n@attribute id numeric\n@attribute x numeric\n@data\n{0 5, 1 2}\n{0 6}\n")
    _, rows = files.read_sparse_arff(spark, tmpdir_fresh)
    assert sorted((r.question_id, r.attr_index, r.val) for r in rows.collect()) == [(5, 1, 2.0), (6, None, None)]


def test_needed_scores_hold_the_whole_top_k(spark):
    tags = 9
    tree = ML.label_tree(spark.range(tags).select(F.col("id").cast("int").alias("tag_index")), 2)
    _, total, _ = ML.tree_params(tree, "tag_index")
    questions = spark.range(6).select(F.col("id").alias("question_id"))
    feats = questions.select("question_id", F.lit(1).alias("bucket"), (F.col("question_id") / 3 + 0.5).alias("value"))
    weights = spark.createDataFrame([(n, 1, math.sin(n * 7.0) * 3) for n in range(total)], "node long, bucket int, w double")
    every = ML.score_labels(questions, feats, weights, tree)
    some = ML.score_needed(questions, feats, weights, tree, 2, 5, 0.3)
    assert every.count() == 6 * tags

    def best(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.question_id, []).append((-r.prob, r.tag_index))
        return {q: [t for _, t in sorted(v)[:5]] for q, v in out.items()}, {(q, t) for q, v in out.items() for p, t in v if -p >= 0.3}

    assert best(every) == best(some)


def test_scratch_tables_can_be_dropped(spark, monkeypatch):
    from tagstream import session

    monkeypatch.setattr(session, "_scratch", {})  # other tests go on reading theirs
    path = os.path.dirname(session.dimension(spark.range(5), "drop-me").inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(path) and session.drop_scratch(spark) == 1 and not os.path.exists(path)
    assert session.drop_scratch(spark) == 0


def test_prefix_sums_over_many_buckets(spark):
    """Hot keys, ties of the order, null and negative values, text-free integers beyond 2^53, one scan of the input."""
    big = 2**60
    rows = [("a" if k % 3 else None, None if k % 17 == 0 else big + (k * 37 % 101) - 50, k, k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, id int, x int")
    out = W.prefix_tracks(df, [W.Track(["k"], ["o", "id"], {"s": F.col("x"), "n": F.lit(1)}), W.Track([], ["o"], ranks={"r": "o"})], "o", n_buckets=37)
    assert out.columns == ["k", "o", "id", "x", "s", "n", "r"]
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    values = sorted({r[1] for r in rows if r[1] is not None})
    got = {r.id: (r.s, r.n, r.r) for r in out.collect()}
    assert len(got) == 400
    for r in rows:
        before = [q for q in rows if q[0] == r[0] and place(q) <= place(r)]
        assert got[r[2]][:2] == (sum(q[3] for q in before), len(before))
        assert got[r[2]][2] == (1 if r[1] is None else 2 + values.index(r[1]))


def test_bucket_is_found_by_binary_search(spark):
    df = spark.createDataFrame([(None,), *[(k / 2,) for k in range(-4, 60)]], "v double")
    for bounds in ([3.0], [0.0, 1.0], [float(k) for k in range(0, 26, 2)], [float(k) for k in range(16)]):
        got = df.select("v", W.bucket_column("v", bounds).alias("b")).collect()
        assert all(r.b == (0 if r.v is None else sum(c <= r.v for c in bounds)) for r in got)
    empty = df.filter("false")
    assert W.order_bounds(empty, "v", 8) == [] and W.prefix_aggregate(empty, [], ["v"], "v", {"s": F.lit(1)}).count() == 0
