"""The class-conditional Kneser-Ney chain against a plain version with dictionaries, and its independence of row order."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagstream.llm import toxicity as T

TEXTS = (["the cat sat on the mat", "a cat and a dog sat", "dogs and cats", "the the the"],
         ["the vile cat", "vile vile dog spat on the mat", "you vileness"])


def _cut(n):
    return max(n - (T.DISCOUNTS[0] if n <= 1 else T.DISCOUNTS[1] if n <= 2 else T.DISCOUNTS[2]), 0)


def _counts():
    uni = [Counter(w for t in texts for w in T.tokens_of(t)) for texts in TEXTS]
    pairs = [Counter(p for t in texts for p in zip(T.tokens_of(t), T.tokens_of(t)[1:])) for texts in TEXTS]
    return uni, pairs


def _plain():
    """log ratio of a word, and of a word after another, from the definition."""
    uni, pairs = _counts()
    vocab = sorted(set(uni[0]) | set(uni[1]))
    stems = sorted({w[:T.STEM] for w in vocab})
    kinds = Counter(w[:T.STEM] for w in vocab)
    stem_n = [Counter({s: sum(n for w, n in u.items() if w[:T.STEM] == s) for s in stems}) for u in uni]

    def shared(n, names, below):
        pooled = {x: n[0][x] + n[1][x] for x in names}
        left = {x: max(v - T.DISCOUNTS[0], 0) for x, v in pooled.items()}
        whole, base = sum(pooled.values()), sum(below.values())
        return {x: (left[x] + (whole - sum(left.values())) * below[x] / base) / whole for x in names}

    def chain(n, names, backoff):
        whole = sum(n[x] for x in names)
        left = {x: _cut(n[x]) for x in names}
        return {x: (left[x] + (whole - sum(left.values())) * backoff[x]) / whole for x in names}

    common = shared(stem_n, stems, {s: kinds[s] / len(vocab) for s in stems})
    stem_p = [chain(stem_n[k], stems, common) for k in (0, 1)]
    mean = {s: (stem_p[0][s] + stem_p[1][s]) / 2 for s in stems}
    within = shared(uni, vocab, {w: mean[w[:T.STEM]] / (kinds[w[:T.STEM]] + 1) for w in vocab})
    word_p = [chain(uni[k], vocab, {w: within[w] * stem_p[k][w[:T.STEM]] / mean[w[:T.STEM]] for w in vocab}) for k in (0, 1)]

    def after(k, v, w):
        own = {b: n for (a, b), n in pairs[k].items() if a == v}
        whole = sum(own.values())
        if not whole:
            return word_p[k][w]
        return _cut(own.get(w, 0)) / whole + (1 - sum(_cut(n) for n in own.values()) / whole) * word_p[k][w]

    return vocab, lambda w: math.log(word_p[1][w] / word_p[0][w]), lambda v, w: math.log(after(1, v, w) / after(0, v, w))


def test_ratios_equal_a_plain_version():
    uni, pairs = _counts()
    batches = [[(list(x[0] for x in part), list(x[1] for x in part), np.array([p[x] for x in part], dtype=float))
                for part in (list(p)[:5], list(p)[5:])] for p in pairs]
    model = T.KneserNey([dict(u) for u in uni], [iter(b) for b in batches])
    vocab, alone, after = _plain()
    for v in vocab:
        for w in vocab:
            got = model.ratios(model.ids(f"{v} {w}"))
            assert got == pytest.approx([alone(v), after(v, w)], abs=1e-5), (v, w)
    assert model.ratios(model.ids("vilest"))[0] == model.ratios(model.ids("vilely"))[0]  # by beginning only
    assert model.ratios(model.ids("zebra")) == pytest.approx([0.0])


def test_scores_do_not_depend_on_row_order(spark):
    """Ids with two texts each, null ids, repeated rows, rows in two orders."""
    rows = [(i, " ".join(TEXTS[i % 3 == 0][(i + k) % 3].split()[k:]) + f" w{i % 11}") for i in range(90) for k in (0, 1)]
    rows += rows[:4] + [(None, "vile cat"), (7, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id int, toxic int")
    seen = []
    for order in (F.col("text").asc(), F.xxhash64("text", F.lit(3))):
        docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3).sortWithinPartitions(order)
        out = T.score_documents(docs, labels, keep=("text",))
        seen.append(sorted((str(r.doc_id), str(r.text), round(r.score, 6)) for r in out.collect()))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
