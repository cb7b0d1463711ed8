"""Secrets by repositories and randomness."""

from pyspark.sql import functions as F

from tagstream.llm import secrets


def test_repositories_and_randomness(spark):
    template, token = "Zx9Kq2Lm8Pw4Rt6Yv1Bn3", "q7Rt2Yh8Lp0Wz5Xc3Vb6N"
    words = ["usr/local/lib/python3/packages", "my-long-blog-post-title-2023", "getUserAccountById2Factory", "20230105-monthly-report-archive"]
    random = ["3f9a0c7be21d48a6f05b", "7KJQ2XWZ5N4RTP3LMB6V", "b3T9-xQ2f_Lm7Zk1Yw8Rc"]
    rows = [(k, f"see {template}", "a", f"r{k}") for k in range(6)] + [(10 + k, f"key {token} here", "a", f"r{k}") for k in range(2)]
    rows += [(20 + k, f"at {w}", f"o{k}", "r") for k, w in enumerate(words)] + [(30 + k, f"at {w}", f"o{k}", "r") for k, w in enumerate(random)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secrets.scan(df, F.col("owner"), F.col("repo")).collect()}
    assert all(got[k].spans == "" for k in range(6))  # one owner, six repositories
    assert all((got[k].spans, got[k].n_live, got[k].repositories) == (f"owned:4:{4 + len(token)}", 1, "2") for k in (10, 11))
    assert [got[20 + k].spans for k in range(len(words))] == [""] * len(words)
    assert [got[30 + k].spans for k in range(len(random))] == [f"owned:3:{3 + len(w)}" for w in random]
