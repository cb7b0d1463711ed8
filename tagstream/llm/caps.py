"""Operator 11, embedding near-dedup by spherical-cap filters.

Filters are directions on the unit sphere; a vector belongs to every filter whose cap it lies in, that
is, whose inner product with it is at least ``alpha``.  Two close vectors share a cap far more often
than two unrelated ones.  The directions are structured: in each of ``ROUNDS`` rotations a direction is
a product of one short codeword for the first half of the coordinates and one for the second, so the
``size * size`` directions of a round need only ``2 * size`` inner products, and list decoding combines
the few codewords of either half that can still reach ``alpha``.

``alpha`` is calibrated on planted pairs at exactly the wanted cosine, with the very code in use, so
that ``RECALL`` of them share a cap; closer pairs do so more often.  Vectors are joined on filters, a
128-bit sign sketch drops far pairs inside the join, and the cosine of what is left is computed in
double precision from the vectors themselves.

Copies.  Equal vectors form one class with a multiplicity.  Where a group of near copies holds a good
share of all rows, its pairs are not enumerated: leaders (mean directions of dense spots in a bounded
sample) get a core, the vectors within half the angle of the threshold.  Any two members of a core are
linked by the triangle inequality, so a core adds its size to each member's links and one star of edges.
Members of one core never meet in the join; all other pairs do.  Leaders only save work: with another
sample, or none, the links are the same.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored
from tagstream.llm.near import components

ROUNDS = 16
#: Share of pairs at exactly the wanted cosine that share a cap.
RECALL = 0.999
#: Codewords of a half: smallest and largest size, and filters for each vector in between.
SMALLEST, LARGEST, FILTERS_A_VECTOR = 64, 1024, 4
#: Leaders come from a sample of this many vectors (fewer of long ones), dense means this many links in it.
SAMPLE_ROWS, SAMPLE_VALUES, DENSE = 16384, 1 << 21, 12
#: Bits of a sign sketch: two columns.
SKETCH_BITS = 128
#: Standard deviations beyond the expected distance of two sketches at the wanted cosine.
MARGIN = 4.5
SEED = 20
_PLANTED = 4000


class Code:
    """The rotations and codewords for vectors of ``d`` components."""

    def __init__(self, d: int, size: int):
        self.d, self.size = d, size
        self.width = max(8, d + d % 2)
        self.half = self.width // 2
        rng = np.random.default_rng([SEED, d, size])
        self.turns, self.words = [], []
        for _ in range(ROUNDS):
            q, r = np.linalg.qr(rng.standard_normal((self.width, self.width)))
            self.turns.append((q * np.sign(np.diag(r))).astype(np.float32))
            w = rng.standard_normal((2, size, self.half))
            self.words.append((w / np.linalg.norm(w, axis=2, keepdims=True) / math.sqrt(2)).astype(np.float32))
        self.signs = rng.standard_normal((self.width, SKETCH_BITS)).astype(np.float32)

    def padded(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.width), dtype=np.float32)
        out[:, :self.d] = unit
        return out

    def halves(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of both halves with the codewords of round ``k``."""
        y = x @ self.turns[k]
        return y[:, :self.half] @ self.words[k][0].T, y[:, self.half:] @ self.words[k][1].T

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """Signs as rows of 64-bit numbers."""
        return np.packbits(x @ self.signs > 0, axis=1).view(np.int64)

    def decode(self, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every cap that holds a row."""
        rows, keys = [], []
        for k in range(ROUNDS):
            a, b = self.halves(x, k)
            ra, ia = np.nonzero(a >= alpha - b.max(axis=1, keepdims=True))
            rb, ib = np.nonzero(b >= alpha - a.max(axis=1, keepdims=True))
            per_row = np.bincount(rb, minlength=len(x))
            start = np.cumsum(per_row) - per_row
            times = per_row[ra]  # each live first half meets the live second halves of its row
            at = np.repeat(np.arange(len(ra)), times)
            second = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + start[ra[at]]
            first_word, second_word, row = ia[at], ib[second], ra[at]
            hit = a[row, first_word] + b[row, second_word] >= alpha
            rows.append(row[hit])
            keys.append(((self.d * ROUNDS + k) * self.size + first_word[hit]) * self.size + second_word[hit])
        return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


@lru_cache(maxsize=8)
def code(d: int, size: int) -> Code:
    return Code(d, size)


@lru_cache(maxsize=64)
def calibrated(d: int, size: int, cosine: float) -> float:
    """The largest ``alpha`` at which ``RECALL`` of planted pairs share a cap."""
    c = code(d, size)
    rng = np.random.default_rng([SEED, d, size, 1])
    x = rng.standard_normal((_PLANTED, max(d, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    best = np.full(_PLANTED, -2.0)
    top = min(size, 24)
    for k in range(ROUNDS):
        pairs = []
        for a, b in zip(c.halves(c.padded(x[:, :d]), k), c.halves(c.padded(y[:, :d]), k)):
            at = np.argpartition(-(a + b), top - 1, axis=1)[:, :top]
            pairs.append((np.take_along_axis(a, at, 1), np.take_along_axis(b, at, 1)))
        (a1, b1), (a2, b2) = pairs
        both = np.minimum(a1[:, :, None] + a2[:, None, :], b1[:, :, None] + b2[:, None, :])
        np.maximum(best, both.max(axis=(1, 2)), out=best)
    return float(np.quantile(best, 1 - RECALL))


def code_size(n: int) -> int:
    size = SMALLEST
    while size < LARGEST and ROUNDS * size * size < FILTERS_A_VECTOR * n:
        size *= 2
    return size


def sketch_limit(cosine: float) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH_BITS * p + MARGIN * math.sqrt(SKETCH_BITS * p * (1 - p)))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so no square overflows or vanishes."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _by_length(column: pa.Array):
    """(positions, matrix) of the rows of each length."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, _matrix(column.take(pa.array(at)), int(d))


def _leaders(sample: list, cosine: float) -> dict[int, np.ndarray]:
    """Mean directions of the dense spots of a sample, by length of the vectors."""
    out = {}
    for at, x in _by_length(pa.array(sample, pa.list_(pa.float64()))) if sample else ():
        u = unit_rows(x)
        counts = np.concatenate([(u[k:k + 512] @ u.T >= cosine).sum(axis=1) for k in range(0, len(u), 512)])
        free, found = counts >= DENSE, []
        for k in np.argsort(-counts, kind="stable"):
            if free[k]:
                fellows = u @ u[k] >= cosine
                free &= ~fellows
                mean = u[fellows].mean(axis=0)
                found.append(mean / np.linalg.norm(mean))
        if found:
            out[u.shape[1]] = np.array(found)
    return out


def _filters(size: int, alphas: dict[int, float], leaders: dict[int, np.ndarray], cosine: float):
    core_cosine = math.cos(math.acos(cosine) / 2) + 1e-9

    def run(batches):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            for at, x in _by_length(batch.column("vec")):
                d = x.shape[1]
                u = unit_rows(x)
                core = np.full(len(u), -1, dtype=np.int64)
                if d in leaders:
                    near = u @ leaders[d].T
                    best = near.argmax(axis=1)
                    inside = near[np.arange(len(u)), best] >= core_cosine
                    core[inside] = d * SAMPLE_ROWS + best[inside]
                c = code(d, size)
                p = c.padded(u)
                rows, keys = c.decode(p, alphas[d])
                order = np.argsort(rows, kind="stable")
                lists = pa.ListArray.from_arrays(np.searchsorted(rows[order], np.arange(len(u) + 1)).astype(np.int32), pa.array(keys[order]))
                s = c.sketch(p)
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(core, mask=core < 0), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), lists],
                                                 names=["cls", "core", "s0", "s1", "keys"])
    return run


def _verified(cosine: float):
    def run(batches):
        for batch in batches:
            keep = []
            for at, x in _by_length(batch.column("vu")):
                y = _matrix(batch.column("vv").take(pa.array(at)), x.shape[1])
                keep.append(at[(unit_rows(x) * unit_rows(y)).sum(axis=1) >= cosine])
            hit = pa.array(np.concatenate(keep) if keep else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("u", "v")], names=["u", "v"])
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one length are linked when the cosine of their angle, in double precision, is at least
    ``cosine``; component_id is the smallest id that links reach, and that id is kept.  A vector that is
    null, empty, zero, or holds a null or non-finite component is linked with nothing and kept.  So is a
    row without an id, whose component_id is null.  Repeated rows, and one id with several vectors, are
    vectors of their own: each counts as a link of the others.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    sound = F.size("vec") > 0
    sound &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("sound", sound)
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2")]
    good = rows.filter("sound").select("id", "vec", *hashes)
    classes = good.groupBy("h1", "h2").agg(F.min(F.struct("id", "vec")).alias("first"), F.count("*").alias("mult"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", F.col("first.id").alias("rep"), "mult", F.col("first.vec").alias("vec"))
    classes = stored(classes, "op11-classes")

    n = classes.count()
    lengths = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]  # kinds of lengths, not rows
    size = code_size(n)
    alphas = {d: calibrated(d, size, cosine) for d in lengths}
    room = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // max(lengths, default=1)))
    sample = classes.select(F.xxhash64("h1", "h2").alias("o"), "cls", F.col("vec").cast("array<double>").alias("vec")).orderBy("o", "cls").limit(room)
    leaders = _leaders([r["vec"] for r in sample.collect()], cosine)

    found = classes.select("cls", F.col("vec").cast("array<double>").alias("vec"))
    found = found.mapInArrow(_filters(size, alphas, leaders, cosine), "cls long, core long, s0 long, s1 long, keys array<long>")
    found = stored(found, "op11-filters")
    members = found.select(F.explode("keys").alias("key"), "cls", "core", "s0", "s1")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", F.col("cls").alias(name), F.col("core").alias(f"core_{name}"), F.col("s0").alias(f"s0_{name}"), F.col("s1").alias(f"s1_{name}"))

    differ = [F.bit_count(F.col(f"{s}_u").bitwiseXOR(F.col(f"{s}_v"))) for s in ("s0", "s1")]
    close = differ[0] + differ[1] <= sketch_limit(cosine)
    alone, cored = members.filter("core is null"), members.filter("core is not null")
    pairs = side(alone, "u").join(side(alone, "v"), "key").filter((F.col("u") < F.col("v")) & close).select("u", "v")
    pairs = pairs.union(side(alone, "u").join(side(cored, "v"), "key").filter(close).select("u", "v"))
    reach = 2 * math.acos(cosine) + 1e-6  # cores of leaders further apart than this hold no linked pair
    for d, l in leaders.items():
        a, b = np.nonzero(np.triu(l @ l.T >= math.cos(min(math.pi, reach)), 1))
        if len(a):
            near = spark.createDataFrame([(int(d * SAMPLE_ROWS + i), int(d * SAMPLE_ROWS + j)) for i, j in zip(a, b)], "core_u long, core_v long")
            two = side(cored, "u").join(F.broadcast(near), "core_u").join(side(cored, "v"), ["key", "core_v"])
            pairs = pairs.union(two.filter(close).select("u", "v"))
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    vec = classes.select("cls", F.col("vec").cast("array<double>").alias("vec"))
    both = pairs.join(vec.select(F.col("cls").alias("u"), F.col("vec").alias("vu")), "u").join(vec.select(F.col("cls").alias("v"), F.col("vec").alias("vv")), "v")
    links = stored(both.mapInArrow(_verified(cosine), "u long, v long"), "op11-links")

    held = found.filter("core is not null").select("cls", "core").join(classes.select("cls", "mult"), "cls")
    cores = stored(held.groupBy("core").agg(F.min("cls").alias("centre"), F.sum("mult").alias("together")), "op11-cores")
    stars = held.join(cores, "core").filter("cls <> centre").select(F.col("cls").alias("u"), F.col("centre").alias("v"))
    roots = components(links.union(stars))

    mult = classes.select(F.col("cls").alias("v"), "mult")
    each = links.union(links.select("v", "u")).toDF("cls", "v").join(mult, "v").groupBy("cls").agg(F.sum("mult").alias("linked"))
    node = classes.select("cls", "h1", "h2", "rep", "mult").join(roots.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    node = node.join(each, "cls", "left").join(held.join(cores, "core").select("cls", "together"), "cls", "left")
    node = stored(node.select("h1", "h2", "root", "rep", (F.coalesce("together", "mult") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "op11-nodes")
    least = node.groupBy("root").agg(F.min("rep").alias("component_id"))
    node = stored(node.join(least, "root").select("h1", "h2", "n_links", "component_id"), "op11-components")

    out = good.select("id", "h1", "h2").join(node, ["h1", "h2"]).select("id", "n_links", "component_id")
    out = out.union(rows.filter("not sound").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
