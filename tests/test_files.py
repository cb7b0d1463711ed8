"""File sources and sinks (S5–S12), configs (F17, F18), grids (J11, J12), invariants."""

import json
import os

from pyspark.sql import functions as F

from tagstream.functions.scalar import config_class
from tagstream.operators import relational as R
from tagstream.operators import windows as W
from tagstream.sources import files as S


def test_sparse_arff(spark, tmpdir_fresh):
    text = "\n".join([
        "@relation demo", "@attribute QuestionId numeric", "@attribute f1 numeric", "@attribute f2 numeric",
        "@attribute L_a {0,1}", "@attribute L_b {0,1}", "@data",
        "{0 11,1 3,4 1}", "{1 2,2 5,3 1}", "{0 13,3 1,4 1}"])
    with open(os.path.join(tmpdir_fresh, "d.arff"), "w") as f:
        f.write(text)
    header, rows = S.read_sparse_arff(spark, tmpdir_fresh, "*.arff")
    h = [(r.attr_index, r.name) for r in header.orderBy("attr_index").collect()]
    assert h == [(0, "QuestionId"), (1, "f1"), (2, "f2"), (3, "L_a"), (4, "L_b")]
    got = sorted((r.question_id, r.attr_index, r.val) for r in rows.collect())
    assert got == [(0, 1, 2.0), (0, 2, 5.0), (0, 3, 1.0), (11, 1, 3.0), (11, 4, 1.0), (13, 3, 1.0), (13, 4, 1.0)]
    roles = {r.name: r.role for r in R.classify_columns(header, "L_").collect()}
    assert roles == {"QuestionId": "id", "f1": "feature", "f2": "feature", "L_a": "label", "L_b": "label"}


def _write_results(root, name, rows):
    head = ["@relation r", "@attribute QuestionId numeric", "@attribute CreatedOn date 'yyyy-MM-dd HH:mm:ss.SSS'",
            "@attribute Fmeasure numeric", "@attribute TopkFmeasure numeric", "@attribute IsTest {0,1}",
            "@attribute IsPrequential {0,1}", "@data"]
    with open(os.path.join(root, name), "w") as f:
        f.write("\n".join(head + rows) + "\n")


def test_results_melt_and_sinks(spark, tmpdir_fresh):
    _write_results(tmpdir_fresh, "run-7-x.arff", [
        "1,'2016-01-01 00:00:01.000',0.5,0.25,0,1", "1,'2016-01-01 00:00:02.000',0.75,0.5,0,0",
        "2,'2016-01-01 00:00:03.000',1,1,0,1"])
    _write_results(tmpdir_fresh, "other-9-y.arff", ["5,'2016-01-02 00:00:00.000',0,0,1,1"])
    res = S.read_results(spark, tmpdir_fresh)
    assert res.count() == 4
    res = S.with_file_learner(res, "part", part=2)
    assert sorted({r.learner for r in res.collect()}) == [7, 9]
    only = S.read_results(spark, tmpdir_fresh, name_text="7", after_pos=2)
    assert only.count() == 3
    bad = S.validate_results(spark, res.drop("learner", "file_name"))
    assert bad.filter(F.col("column") == "is_test").count() == 0
    wide = res.filter(F.col("learner") == 7).select(
        F.col("learner").cast("string").alias("learner"), "question_id", "created_on",
        F.round(F.col("fmeasure") * 50000).cast("long").alias("fm_units"),
        F.round(F.col("topk_fmeasure") * 50000).cast("long").alias("topk_units"),
        F.col("is_prequential").cast("int").alias("is_prequential"), F.col("is_test").cast("int").alias("is_test"))
    melted = W.melt_results(wide)
    # invariant: cumulative F + cumulative regret = record count per category
    last = melted.groupBy("category").agg(F.max(F.col("cum_fm") + F.col("cum_regret")).alias("s"),
                                          F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r.s - r.n) < 1e-9 for r in last)
    out = os.path.join(tmpdir_fresh, "melted")
    S.write_melted(melted, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == melted.count() and "cum_regret" in back.columns
    S.append_results(wide, os.path.join(tmpdir_fresh, "store"))
    S.append_results(wide, os.path.join(tmpdir_fresh, "store"))
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "store")).count() == 2 * wide.count()


def test_validate_reports_domain(spark):
    df = spark.createDataFrame([(1, None, 0.1, 0.2, "0", "2")],
                               "question_id long, created_on timestamp_ntz, fmeasure double, topk_fmeasure double, "
                               "is_test string, is_prequential string")
    probs = {(r.column, r.problem) for r in S.validate_results(spark, df).collect()}
    assert ("is_prequential", "value outside domain: 2") in probs
    assert ("is_test", "domain value never seen: 1") in probs


def test_learner_configs(spark, tmpdir_fresh):
    cfg = ["BoostedConfig", {"ensembleSize": 10, "minEpochs": 30, "isToAggregateByMajorityVote": True,
                             "individualPLTConfiguration": ["PLTConfig", {"hd": 16384}]}]
    with open(os.path.join(tmpdir_fresh, "abc.json"), "w") as f:
        json.dump(cfg, f)
    c = S.read_learner_configs(spark, tmpdir_fresh)
    r = c.select("learner_id", S.boosted_config_label(F.col("config")).alias("label")).first()
    assert (r.learner_id, r.label) == ("abc", "16384-10-30-MV")


def test_config_class_trial_order(spark):
    rows = [('{"hd": 1, "epochs": 2}',), ('{"ensembleSize": 1, "minEpochs": 2}',),
            ('{"ensembleSize": 1, "toAggregateByLambdaCW": true}',), ('{"epsilon": 0.1, "a": 1}',), ('{"zzz": 1}',)]
    df = spark.createDataFrame(rows, "j string")
    got = [r[0] for r in df.select(config_class("j")).collect()]
    assert got == ["AdaptivePLT", "PLTEnsembleBoosted", "PLTEnsembleBoostedWithThreshold", "PLTAdaptiveEnsemble", None]


def test_param_grid_and_minus(spark):
    g = R.param_grid(spark, hd=[16384, 32768], size=[10, 20], vote=["MV", "FM"], epochs=[10, 30])
    assert g.count() == 16 and g.distinct().count() == 16
    ignored = spark.createDataFrame([("16384 - 10 - MV - 10",), ("32768 - 20 - FM - 30",)], "config string")
    assert R.grid_minus(g, ignored, ["hd", "size", "vote", "epochs"]).count() == 14


def test_unprocessed_plus_processed_is_all(spark, fx):
    todo = R.unprocessed(fx.question, fx.result, "L1")
    done = fx.question.join(fx.result.filter(F.col("learner") == "L1").select("question_id"), "question_id", "left_semi")
    assert todo.count() + done.count() == fx.question.count()


def test_decode_unknown_index_leaves_null(spark):
    pred = spark.createDataFrame([(1, [0, 99], [99, 1])], "question_id long, general array<int>, topk array<int>")
    tags = spark.createDataFrame([(0, "a"), (1, "b")], "tag_index int, name string")
    r = R.decode_predictions(pred, tags).first()
    assert r.topk == [None, "b"]
    assert sorted(r.general, key=lambda x: (x is not None, x)) == [None, "a"]


def test_malformed_result_lines_are_reported(spark, tmpdir_fresh):
    good = "1,'2020-01-01 00:00:00',0.5,0.25,0,1"
    with open(os.path.join(tmpdir_fresh, "a.arff"), "w") as f:
        f.write("@relation r\n@data\n" + good + "\nnot a row\nx,'2020-01-01 00:00:00',0.5,0.25,0,1\n\n")
    assert S.read_results(spark, tmpdir_fresh).count() == 1
    assert sorted(r.line for r in S.malformed_results(spark, tmpdir_fresh).collect()) == ["not a row", "x,'2020-01-01 00:00:00',0.5,0.25,0,1"]


def test_learner_configs_are_written_under_their_names_by_the_tasks(spark, tmpdir_fresh, monkeypatch):
    path = os.path.join(tmpdir_fresh, "many")
    df = spark.range(500).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("learner_id"), F.col("id").cast("string").alias("config"))
    df = df.unionByName(spark.createDataFrame([("a/b", "x"), ("a/b", "w")], df.schema)).repartition(7)
    monkeypatch.setattr(S, "_rename_parts", None)  # the driver renames nothing
    S.write_learner_configs(df, path)
    assert sorted(os.listdir(path)) == sorted([f"L{k}.json" for k in range(500)] + ["a%2Fb.json"])
    got = S.read_learner_configs(spark, path)
    assert got.rdd.getNumPartitions() <= S.CONFIG_TASKS * spark.sparkContext.defaultParallelism
    rows = {(r.learner_id, r.config.strip()) for r in got.collect()}
    assert rows >= {(f"L{k}", str(k)) for k in range(500)}
    assert open(os.path.join(path, "a%2Fb.json")).read() == "w\nx\n"
