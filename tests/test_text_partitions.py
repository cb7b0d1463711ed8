"""Texts reach the counting of words in partitions of bounded size, however few the session sets."""

from pyspark.sql import functions as F

from tagstream import session
from tagstream.operators import aggregates as A


def test_partitions_follow_the_texts(spark, monkeypatch):
    from tagstream.plans.fixtures import Fixtures

    plain = Fixtures(spark, "/root/testdata/sf0.001")
    want = {tuple(r) for r in A.term_frequencies(plain.feature_text, "text").collect()}
    total = plain.t.documents.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(session, "TEXT_BYTES", total // 50)
    small = Fixtures(spark, "/root/testdata/sf0.001")
    assert session.text_partitions(small.t.documents, "text") >= 50
    sizes = [r[0] for r in small.question.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("body"))).select("sum(octet_length(body))").collect()]
    assert len(sizes) > 20 and max(sizes) < total / 4
    assert {tuple(r) for r in A.term_frequencies(small.feature_text, "text").collect()} == want


def test_rows_of_thresholds_are_not_broadcast(spark):
    from tagstream.operators.thresholds import thresholds

    rows = spark.range(400).select((F.col("id") % 3).cast("int").alias("tag_index"), F.col("id").alias("question_id"),
                                   (F.col("id") * 37 % 100 / 100.0).alias("score"), (F.col("id") % 2).cast("int").alias("y"))
    plan = thresholds(rows, bits=4)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
