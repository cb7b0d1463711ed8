"""Foreign text and text without common words is rejected, clean text is kept, whatever the length."""

import math
from collections import Counter

import numpy as np
import pytest

from tagstream.llm import divergence

RNG = np.random.default_rng(3)
VOCAB, SHARE = 3000, 1 / (np.arange(3000) + 10)  # 32 words hold a quarter of the text


def text(lang, n):
    words = RNG.choice(VOCAB, n, p=SHARE / SHARE.sum())
    return " ".join(f"{lang}{''.join(chr(97 + int(d)) for d in str(k))}" for k in words)


def test_foreign_text(spark):
    rows = [(i, "ab"[i % 2], text("ab"[i % 2], n)) for i, n in enumerate(RNG.integers(110, 900, 1200).tolist())]
    odd = [(5000 + i, "ab"[i % 2], text("ba"[i % 2], n)) for i, n in enumerate((120, 150, 200, 300, 500, 800))]
    odd += [(6000 + n, "a", " ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))) for n in (120, 200, 400)]
    df = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in divergence.quality(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert not [i for i, _, _ in odd if got[i].kept]
    assert sum(got[i].kept for i, _, _ in rows) >= 0.97 * len(rows)
    # the distance itself, against plain Python
    for lang in "ab":
        count = Counter(w for _, x, t in rows + odd if x == lang for w in t.split())
        total = sum(count.values())
        top = sorted(count, key=lambda w: (-count[w], w))[:divergence.COMMON]
        q = [count[w] / total for w in top]
        for i, t in [(i, t) for i, x, t in rows + odd if x == lang][::40]:
            c, n = Counter(t.split()), len(t.split())
            p = [c[w] / n for w in top]
            pairs = list(zip(p + [1 - sum(p)], q + [1 - sum(q)]))
            half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
            assert got[i].word_distance == pytest.approx(math.sqrt(sum(half(a, b) + half(b, a) for a, b in pairs) / 2))
