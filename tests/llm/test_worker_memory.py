"""What Python workers hold at a time: slices of a batch in op6, one copy of a text in the toxicity stage."""

import random

import pytest

from tagstream.llm import bytepair, toxicity
from tagstream.llm.queries import tokenizer_file


def test_batches_are_encoded_in_slices(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c'\n1é") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + ["", "x" * 300, "it's"]
    model = bytepair.BytePair(bytepair.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))
    want = [model.encode_batch([t])[0] for t in texts]
    seen, cut = [], bytepair.piece_starts
    monkeypatch.setattr(bytepair, "piece_starts", lambda codes, starts: (seen.append((len(codes), len(starts))), cut(codes, starts))[1])
    monkeypatch.setattr(bytepair, "SLICE_CHARS", 100)
    assert model.encode_batch(texts) == want and model.encode_batch([]) == []
    assert sum(n for n, _ in seen) == sum(map(len, texts)) and all(n <= 100 or k == 1 for n, k in seen)


def test_kept_text_is_scored_from_one_copy(spark):
    rows = [(i, f"vile w{i % 3}" if i % 3 == 0 else f"cat w{i % 5}") for i in range(60)] + [(60, None), (61, ""), (None, "vile")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id int, toxic int")
    alone = toxicity.score_documents(docs, labels)
    kept = toxicity.score_documents(docs, labels, keep=("text", "doc_id"))
    assert sorted((str(r.doc_id), r.score) for r in kept.collect()) == sorted((str(r.doc_id), r.score) for r in alone.collect())
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS text#") == 1  # the result's, not one more of the workers' input


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_pairs_reach_the_driver_in_parts(spark, monkeypatch, parts):
    docs = spark.range(80).selectExpr("cast(id as int) as doc_id", "concat_ws(' ', if(id % 3 = 0, 'vile', 'cat'), concat('w', id % 7), concat('w', id % 5), 'the end') as text")
    labels = spark.range(80).selectExpr("cast(id as int) as doc_id", "cast(id % 3 = 0 as int) as toxic")
    whole, link = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "PARTS", parts)
    seen, build = [], toxicity.KneserNey.__init__
    monkeypatch.setattr(toxicity.KneserNey, "__init__", lambda self, uni, pairs: build(self, uni, [(seen.append(len(b[0])) or b for b in p) for p in pairs]))
    again, _ = toxicity.fit(docs, labels)
    a, b = whole.value, again.value
    assert a.keys.tolist() == sorted(a.keys.tolist()) == b.keys.tolist() and sum(seen) >= len(a.keys)
    assert a.pair.tolist() == b.pair.tolist() and a.backoff.tolist() == b.backoff.tolist()
    assert parts == 1 or max(seen) < sum(seen) / 2
