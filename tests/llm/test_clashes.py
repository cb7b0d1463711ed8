"""Clashing names, ids of any type, repeated ids, long words: no crash, and a defined result."""

import time

import corpus_pipeline as C
from pyspark.sql import functions as F

from tagstream.llm import lines, mixing, passages, personal
from tagstream.llm import queries as Q

PASSAGE = " ".join(f"p{k}" for k in range(60))


def test_a_mixed_table_can_be_mixed_again(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", f"src{k % 3}") for k in range(40)], "doc_id long, text string, lang string, source string")
    once = mixing.mix(docs, Q.mix_levels(), Q.MIX_WEIGHTS, 1.0, 1)
    again = mixing.mix(once, Q.mix_levels(), Q.MIX_WEIGHTS, 1.0, 1)
    assert sorted(again.columns) == sorted(once.columns)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in once.collect())


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, f"x\n{PASSAGE}"), (2, f"y\n{PASSAGE}")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("own") for c in ("__hash", "__left", "__runs", "id", "th", "runs", "r", "left", "lines", "gone")})
    for dedup in (passages.dedup_passages, lines.dedup_lines):
        rows = {r.doc_id: r for r in dedup(docs).collect()}
        assert rows[1].text == f"x\n{PASSAGE}" and rows[2].text == "y" and rows[2].gone_lines == "1"
        assert all(rows[2][c] == "own" for c in ("__hash", "__left", "__runs", "id", "th", "runs", "r", "left", "lines", "gone"))


def test_near_copies_by_row(spark):
    near = " ".join(f"n{k}" for k in range(40))
    rows = [("b", near), ("a", near + " more"), ("c", "other words of its own here"), ("c", near), ("c", "other words of its own here"), (None, near), (None, near), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("key", F.lit("own")).withColumn("r", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in C.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([("a", near + " more"), ("c", "other words of its own here"), (None, near), (None, near), ("d", None)], key=str)
    numbers = docs.withColumn("doc_id", F.when(F.col("doc_id") == "a", -5).when(F.col("doc_id") == "b", 7).when(F.col("doc_id") == "c", 100).when(F.col("doc_id") == "d", 12).cast("long"))
    assert sorted(((r.doc_id, r.text) for r in C.near_copies(spark, numbers, "").collect()), key=str) == sorted(
        [(-5, near + " more"), (100, "other words of its own here"), (None, near), (None, near), (12, None)], key=str)


def test_empty_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert C.near_copies(spark, docs, "").columns == docs.columns and C.near_copies(spark, docs, "").count() == 0


def test_long_words_cost_little():
    text = "x" * 40000 + " mail a@b.cd " + "y" * 40000
    began = time.time()
    assert [text[a:b] for a, _, b in personal.base_spans(text)] == ["a@b.cd"]
    assert personal.Document(text, personal.base_spans(text)).start == [40006]
    assert time.time() - began < 1


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("call +155512345"), F.col("id").cast("string")).alias("text"))
    seen = []
    learn = personal._learn
    personal._learn = lambda d: (seen.append(len(d)), learn(d))[1]
    try:
        personal.fit(docs, "doc_id", "text", 10)
    finally:
        personal._learn = learn
    assert seen == [10]
