"""The near-dedup stage removes rows, not ids."""

import corpus_pipeline as C


def words(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_ids_with_several_texts(spark):
    a, b, c = words("a"), words("b"), words("c")
    rows = [(3, a, "s"), (5, a + " end", "s"), (5, b, "s"), (7, c, "s"), (7, c, "s"), (7, c, "t"), (8, c, "s"), (-2, words("d"), "s"),
            (10, words("d"), "s"), (9, "", "s"), (None, a, "s"), (None, a, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in C.near_copies(spark, df, "").collect()), key=str)
    want = [(3, a, "s"), (5, b, "s"), (7, c, "s"), (-2, words("d"), "s"), (9, "", "s"), (None, a, "s"), (None, a, "s")]
    assert got == sorted(want, key=str)
