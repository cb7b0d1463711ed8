"""Operator 2, toxicity: class-conditional Kneser-Ney language models.

Two models, one of labelled-toxic and one of ordinary texts, give each token a log-likelihood ratio.
Each is an interpolated Kneser-Ney chain: word after word, word, word beginning (the first five
characters), and at the bottom counts that both classes share, namely how many different words of
either class continue a beginning.  A rare expression therefore backs off to evidence from its
beginning and, where neither class has any, to the same shared value in both models, which cancels.

The ratio of a text is normalised by length twice: over the whole text, and over its most toxic run
of ``WINDOW`` tokens (so that a remark in a long text is not averaged away).  A logistic link turns
the two ratios and the log length into a score from 0 to 1.

The models are fitted on a bounded sample of labelled rows, ``MAX_PER_CLASS`` of each class in hash
order; counts come from three of the training folds and the link from the fourth, so the link sees
texts that the counts have not.  Everything else covers all rows.  Labels, language, source and id
are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagstream.llm.common import fold, prepare, stored, text_of

#: Bound of the labelled sample: rows of each class.
MAX_PER_CLASS = 5000
STEM = 5
WINDOW = 8
#: Discounts of counts of one, two, and three or more.
DISCOUNTS = (0.95, 1.3, 1.6)
TOP = 3
#: Parts in which pairs come to the driver and become ratios.
PARTS = 8
N_FEATURES = 5

_WORD = re.compile(r"\w+")


def tokens_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _discount(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney: a count seen once is nearly all given to the backoff."""
    return np.where(n <= 1, DISCOUNTS[0], np.where(n <= 2, DISCOUNTS[1], DISCOUNTS[2]))


def _shared(n: list[np.ndarray], below: np.ndarray) -> np.ndarray:
    """The distribution that both classes back off to: their pooled counts over ``below``."""
    pooled = n[0] + n[1]
    left = np.maximum(pooled - DISCOUNTS[0], 0)
    return (left + (pooled.sum() - left.sum()) * below / below.sum()) / pooled.sum()


def _interpolate(n: list[np.ndarray], backoff) -> list[np.ndarray]:
    out = []
    for k in (0, 1):
        left = np.maximum(n[k] - _discount(n[k]), 0)
        whole = max(1.0, n[k].sum())
        out.append((left + (whole - left.sum()) * (backoff[k] if isinstance(backoff, list) else backoff)) / whole)
    return out


class KneserNey:
    """Log-likelihood ratios (toxic over ordinary) of words and of pairs of words."""

    def __init__(self, uni: list[dict[str, int]], pairs: list[Iterable[tuple[list[str], list[str], np.ndarray]]]):
        """For the ordinary and the toxic class: counts of words; and, in batches that are read once, of
        pairs (first, second, counts).  A class that has no pair with a first word backs off wholly there."""
        vocab = sorted(set(uni[0]) | set(uni[1]))
        self.id = {w: k for k, w in enumerate(vocab)}
        stem_words = Counter(w[:STEM] for w in vocab)  # shared continuation counts
        stems = sorted(stem_words)
        self.stem_id = {s: len(vocab) + k for k, s in enumerate(stems)}
        self.unknown = len(vocab) + len(stems)
        stem_at = np.array([self.stem_id[w[:STEM]] - len(vocab) for w in vocab], dtype=np.int64)
        n_stem = [np.bincount(stem_at, weights=[u.get(w, 0) for w in vocab], minlength=len(stems)) for u in uni]
        n_word = [np.array([u.get(w, 0) for w in vocab], dtype=np.float64) for u in uni]
        kinds_of = np.array([stem_words[s] for s in stems], dtype=np.float64)
        stem_p = _interpolate(n_stem, _shared(n_stem, kinds_of / kinds_of.sum()))
        within = _shared(n_word, (stem_p[0] + stem_p[1])[stem_at] / 2 / (kinds_of[stem_at] + 1.0))
        # a word's backoff carries its beginning's ratio, so an unseen word inherits it
        word_p = _interpolate(n_word, [within * stem_p[k][stem_at] / ((stem_p[0] + stem_p[1])[stem_at] / 2) for k in (0, 1)])
        self.single = np.concatenate([np.log(word_p[1] / word_p[0]), np.log(stem_p[1] / stem_p[0]), [0.0]]).astype(np.float32)
        # word after word
        width = self.unknown + 1
        found = []
        for k in (0, 1):
            key, n = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for v, w, x in pairs[k]:
                key.append(np.fromiter(map(self.id.__getitem__, v), np.int64, len(v)) * width + np.fromiter(map(self.id.__getitem__, w), np.int64, len(w)))
                n.append(x)
            key, n = np.concatenate(key), np.concatenate(n)
            order = np.argsort(key)
            found.append((key[order], n[order]))
            del key, n, order
        self.backoff = np.zeros(width, dtype=np.float32)
        keys, ratios = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        # the pairs of some first words at a time, so only the counts and the result are held whole
        some = -(-len(vocab) // PARTS)
        for low in range(0, len(vocab), some):
            cut = [np.searchsorted(f[0], (low * width, (low + some) * width)) for f in found]
            mine = [(f[0][i:j], f[1][i:j]) for f, (i, j) in zip(found, cut)]
            at = np.union1d(mine[0][0], mine[1][0])
            a, b = at // width - low, at % width
            keep, p = [np.ones(some) for _ in uni], []
            for k in (0, 1):
                n = np.zeros(len(at))
                n[np.searchsorted(at, mine[k][0])] = mine[k][1]
                whole = np.bincount(a, weights=n, minlength=some)  # times the class has a word after the first
                seen = np.flatnonzero(whole)
                left = np.maximum(n - _discount(n), 0)
                kept = np.bincount(a, weights=left, minlength=some)
                keep[k][seen] = 1 - kept[seen] / whole[seen]
                p.append(left / np.maximum(whole[a], 1) + keep[k][a] * word_p[k][b])
            high = min(low + some, len(vocab))
            self.backoff[low:high] = np.log(keep[1] / keep[0])[:high - low]
            keys.append(at)
            ratios.append(np.log(p[1] / p[0]).astype(np.float32))
        del found
        self.keys, self.pair = np.concatenate(keys), np.concatenate(ratios)

    def ids(self, text: str) -> np.ndarray:
        look, stems, unknown = self.id, self.stem_id, self.unknown
        words = tokens_of(text)
        out = np.array([look.get(w, -1) for w in words], dtype=np.int64)
        for k in np.flatnonzero(out < 0).tolist():
            out[k] = stems.get(words[k][:STEM], unknown)
        return out

    def ratios(self, ids: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of every token after the one before it."""
        r = self.single[ids].astype(np.float64)
        if len(ids) > 1:
            r[1:] += self.backoff[ids[:-1]]
            if len(self.keys):
                key = ids[:-1] * (self.unknown + 1) + ids[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                r[1 + hit] = self.pair[at[hit]]
        return r

    def features(self, text: str) -> tuple[float, ...]:
        """Ratios per token: of the whole text, of its most toxic run, of its most toxic tokens; log length."""
        ids = self.ids(text)
        if not len(ids):
            return (0.0,) * N_FEATURES
        r = self.ratios(ids)
        run = np.concatenate([[0.0], np.cumsum(r)])
        w, t = min(WINDOW, len(r)), min(TOP, len(r))
        top = np.partition(r, len(r) - t)[len(r) - t:]
        return float(run[-1] / len(r)), float(((run[w:] - run[:-w]) / w).max()), float(top.mean()), float(top.min()), float(np.log1p(len(r)))


def fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps; returns weights, means and scales."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * w)
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_per_class: int = MAX_PER_CLASS):
    """(model, link) from at most ``max_per_class`` labelled training rows of each class.

    Of labels that contradict each other for one id, toxic wins; null labels and ids are left out.
    Without rows of both classes the model is None and every text scores 0.
    """
    of_labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id") != 0)).groupBy("id").agg(F.max("y").alias("y"))
    ids = None
    for y in (0, 1):
        part = of_labels.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        ids = part if ids is None else ids.union(part)
    # bounded by 2 * max_per_class rows, so its broadcast is
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    # of several texts of an id the one with the least hash, so the order of rows does not matter
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))
    sample = sample.groupBy("id", "y").agg(one.alias("one")).select("id", "y", F.col("one.text").alias("text"), (fold("id") == 1).alias("link"))

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for text, y, link in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("link").to_pylist()):
                if not link:
                    w = tokens_of(text)
                    c.update(zip([y] * len(w), ["", *w[:-1]], w))
        keys = list(c)
        yield pa.RecordBatch.from_pydict({"y": pa.array([k[0] for k in keys], pa.int32()), "v": pa.array([k[1] for k in keys], pa.string()),
                                          "w": pa.array([k[2] for k in keys], pa.string()), "n": pa.array(c.values(), pa.int64())})

    # all of what follows is bounded by the sample
    counted = sample.select("text", "y", "link").mapInArrow(count, "y int, v string, w string, n long").groupBy("y", "v", "w").agg(F.sum("n").alias("n"))
    counted = stored(counted, "op2-counts")
    uni: list[dict[str, int]] = [{}, {}]
    for b in counted.groupBy("y", "w").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for y, w, n in zip(*(b.column(c).to_pylist() for c in ("y", "w", "n"))):
            uni[y][w] = n
    if not uni[0] or not uni[1]:
        return None, None

    def pairs(y: int):
        own = counted.filter((F.col("y") == y) & (F.col("v") != ""))
        for part in range(PARTS):  # the driver holds one part as strings
            for b in own.filter(F.pmod(F.hash("v"), F.lit(PARTS)) == part).select("v", "w", "n").toArrow().to_batches():
                yield b.column("v").to_pylist(), b.column("w").to_pylist(), b.column("n").to_numpy().astype(np.float64)

    model = KneserNey(uni, [pairs(0), pairs(1)])
    del uni
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def featurise(batches):
        m = shared.value
        for b in batches:
            x = [m.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), **{f"x{k}": pa.array([r[k] for r in x], pa.float64()) for k in range(N_FEATURES)}})

    rows = sample.filter("link").select("text", "y").mapInArrow(featurise, "y int, " + ", ".join(f"x{k} double" for k in range(N_FEATURES))).collect()  # bounded by the sample
    x = np.array([[r[f"x{k}"] for k in range(N_FEATURES)] for r in rows], dtype=np.float64).reshape(-1, N_FEATURES)
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if len(rows) < 2 or y.min() == y.max():  # too few rows for a link: the plain sign of the run's ratio
        return shared, (np.array([0.0, 4.0, 0.0, 0.0, 0.0, -4.0]), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    # the sample holds the classes in other shares than the labels do; the weights go half of the way
    # (in log) to the labels' shares, since a missed toxic text costs more than a clean one dropped
    share = {r["y"]: r["n"] for r in of_labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = np.sqrt(np.where(y > 0, share[1] / y.sum(), share[0] / (1 - y).sum()))
    return shared, fit_link(x, y, weight / weight.mean())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_per_class: int = MAX_PER_CLASS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (score >= 0.5), and the columns of ``keep``.

    held_out rows (crc32 of the id modulo 5 is 0) are never learned from; a null id is no training row
    and not held out.  Null and empty texts are scored as texts without words.
    """
    prepare(docs.sparkSession)
    model, link = fit(docs, labels, id_col, text_col, label_col, max_per_class)
    held = F.coalesce(fold(id_col) == 0, F.lit(False))
    # a text that is kept anyway goes to the workers once
    at = keep.index(text_col) if text_col in keep and isinstance(docs.schema[text_col].dataType, StringType) else None
    scored = "text" if at is None else f"keep_{at}"
    rows = docs.select(*[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)], F.col(id_col).alias("id"),
                       held.alias("held_out"), *([text_of(text_col).alias("text")] if at is None else []))
    names = [f"keep_{k}" for k in range(len(keep))] + ["id", "held_out"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def score(batches):
        m = model.value if model is not None else None
        for b in batches:
            texts = [t or "" for t in b.column(scored).to_pylist()]
            p = np.zeros(len(texts))
            if m is not None and texts:
                w, mean, scale = link
                x = np.array([m.features(t) for t in texts])
                z = np.c_[(x - mean) / scale, np.ones(len(x))] @ w
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names]) + ", score double, predicted int"
    out = rows.mapInArrow(score, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep) if c != id_col])
