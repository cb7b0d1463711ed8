"""Pipeline stages take and give the columns of documents, and act on all that they get."""

import corpus_pipeline as C
import brute as B

SMALL = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, deduped, near, _, last = [f for _, f in C.STAGES]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = deduped(spark, docs, SMALL)
    assert out.columns == docs.columns
    gone = B.line_runs(rows, 50)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in rows}
    want = {i: t for i, t in want.items() if i not in gone or B.WORD.search(t)}
    assert {r.doc_id: r.text for r in out.collect()} == want
    kept = near(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in B.near(rows, 5, 80).items() if i == c}
    assert last(spark, docs.limit(20), SMALL).columns == ["doc_id", "ids", "offsets"]


def test_run(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() < 200
