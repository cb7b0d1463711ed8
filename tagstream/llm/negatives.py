"""Operator 13, hard-negative mining with an inverted multi-index.

The two halves of the coordinates have a codebook each; a row lies in the cell of its two nearest
codewords.  For an anchor, a codeword of a half bounds the half-scores of all rows assigned to it:
inner product with the codeword, plus length of the anchor's half times the largest distance of such a
row from the codeword.  The sum of both halves' bounds holds for the whole cell.  The multi-sequence
heap walks the two sorted lists of bounds and yields the cells in descending order of that sum, so the
search of an anchor stops as soon as no unvisited cell can change its result: a certificate, not a guess.

Positives: the best rows of the anchor's label.  Negatives: for every positive, the best rows of other
labels whose score lies in a window given in hundredths of the positive's score.

The index is a table in the order of the cells, range-partitioned, so a cell that holds a third of all
rows spreads over several partitions.  A task walks its partition in blocks of ``BLOCK_ROWS`` rows, each
with its own cells and radii, and carries each anchor's best rows from block to block.  Anchors are sent
to the tasks in chunks of at most ``CHUNK_VALUES`` components; every chunk meets all rows.  All scores
are whole numbers and compared as such; bounds are rounded up.

The codebooks are fitted on a bounded sample (``SAMPLE_ROWS``, ``SAMPLE_VALUES``); any codebooks give the
same result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored

#: Codewords of a half, rounds of fitting, and the sample they are fitted on.
WORDS, ROUNDS, SAMPLE_ROWS, SAMPLE_VALUES = 32, 6, 8192, 1 << 20
BLOCK_ROWS = 8192
#: Rows of visited cells that are scored together.
VISIT_ROWS = 512
#: Components of the anchors that are sent out at a time (8 bytes each).
CHUNK_VALUES = 1 << 22
SCALE = 256
SEED = 13
_NO_ID = (1 << 63) - 1
_MOST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): doubles where these hold the numbers exactly, else Python integers."""
    if x.size and np.abs(x).max() >= 2.0 ** 44:
        exact = [[int(v) * SCALE if abs(v) >= 2.0 ** 44 else math.floor(v * SCALE) for v in row] for row in x.tolist()]
        return np.array(exact, dtype=object).reshape(x.shape)
    return np.floor(x * SCALE)


def _size(q: np.ndarray) -> int:
    return int(np.abs(q).max()) if q.size else 0


class Books:
    """The codebooks of both halves, for vectors of one length."""

    def __init__(self, q: np.ndarray):
        self.half = (q.shape[1] + 1) // 2
        rng = np.random.default_rng(SEED)
        self.words = [self._fit(part, rng) for part in (q[:, :self.half], q[:, self.half:])]

    @staticmethod
    def _fit(x: np.ndarray, rng) -> np.ndarray:
        x = np.unique(x, axis=0)
        words = x[rng.choice(len(x), min(WORDS, len(x)), replace=False)]
        for _ in range(ROUNDS):
            near = _nearest(x, words)
            words = np.array([x[near == k].mean(axis=0) if (near == k).any() else words[k] for k in range(len(words))])
        return words

    def cells(self, q: np.ndarray) -> np.ndarray:
        a, b = (_nearest(part, w) for part, w in zip((q[:, :self.half], q[:, self.half:]), self.words))
        return a * WORDS + b


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1)[None, :] - 2 * (x @ words.T)).argmin(axis=1)


class Block:
    """Rows in the order of their cells, and what bounds the scores of a cell."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, books: Books | None):
        order = np.argsort(cells, kind="stable")
        self.q, self.ids, self.labels = q[order], ids[order], labels[order]
        self.books, self.size = books, _size(q)
        present, start = np.unique(cells[order], return_index=True)
        self.spans = dict(zip(present.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(q)])))
        if books is None or q.dtype == object:
            self.halves = None
            return
        self.halves = []
        for part, words, which in ((self.q[:, :books.half], books.words[0], cells[order] // WORDS), (self.q[:, books.half:], books.words[1], cells[order] % WORDS)):
            used, at = np.unique(which, return_inverse=True)
            radius = np.zeros(len(used))
            np.maximum.at(radius, at, np.sqrt(((part - words[which]) ** 2).sum(axis=1)))
            self.halves.append((used, words[used], radius))

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Of each anchor and half, the bounds of the half-scores by codeword."""
        out = []
        for part, (_, words, radius) in zip((anchors[:, :self.books.half], anchors[:, self.books.half:]), self.halves):
            s = part @ words.T + np.sqrt((part * part).sum(axis=1))[:, None] * radius[None, :]
            out.append(s + 1e-9 * np.abs(s) + 1e-3)
        return out

    def visit(self, first: np.ndarray, second: np.ndarray):
        """(bound, start, end) of the cells in descending order of their bounds: the multi-sequence heap."""
        rows, cols = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
        a, b = first[rows].tolist(), second[cols].tolist()
        names = [(self.halves[0][0][rows] * WORDS).tolist(), self.halves[1][0][cols].tolist()]
        heap, spans = [(-(a[0] + b[0]), 0, 0)], self.spans
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            span = spans.get(names[0][i] + names[1][j])
            if span:
                yield -bound, *span

    def scores(self, start: int, end: int, anchor: np.ndarray, anchor_size: int) -> np.ndarray:
        q = self.q[start:end]
        if q.dtype != object and anchor.dtype != object and self.size * anchor_size * max(1, len(anchor)) < 2 ** 53:
            return (q @ anchor).astype(np.int64)
        exact = [sum(int(x) * int(y) for x, y in zip(row, anchor)) for row in q]
        return np.array([max(-_MOST, min(_MOST, s)) for s in exact], dtype=np.int64)


class Best:
    """The ``k`` best (score, id) in a window of scores; higher scores first, then smaller ids."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low: int = -_MOST, high: int = _MOST):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """A row below this score changes nothing."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = (scores >= self.least) & (scores <= self.high)
        if hit.any():
            scores, ids = np.concatenate([self.scores, scores[hit]]), np.concatenate([self.ids, ids[hit]])
            best = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[best], ids[best]


def search(block: Block, anchors: np.ndarray, sizes: list[int], ids, labels, same: bool, wanted: list[list[Best]]) -> None:
    """Improves what each anchor wants by the rows of a block."""
    bounded = block.halves is not None and anchors.dtype != object
    first, second = block.bounds(anchors) if bounded else (None, None)
    for n, (anchor, best) in enumerate(zip(anchors, wanted)):
        if not best:
            continue
        least = min(b.least for b in best)
        cells = block.visit(first[n], second[n]) if bounded else iter([(math.inf, 0, len(block.q))])
        done = False
        while not done:
            spans, held = [], 0
            for bound, start, end in cells:
                if bound < least:
                    done = True
                    break
                spans.append((start, end))
                held += end - start
                if held >= VISIT_ROWS:
                    break
            else:
                done = True
            if not spans:
                break
            scores = np.concatenate([block.scores(s, e, anchor, sizes[n]) for s, e in spans])
            found = np.concatenate([block.labels[s:e] for s, e in spans]) == labels[n]
            if not same:
                found = ~found
            found &= scores >= least
            if not found.any():
                continue
            hit = np.concatenate([block.ids[s:e] for s, e in spans])
            found &= hit != ids[n]
            scores, hit = scores[found], hit[found]
            for b in best:
                b.add(scores, hit)
            least = min(b.least for b in best)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _celled(books: dict[int, Books]):
    def run(batches):
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy()
            cells = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                q = whole(_matrix(batch.column("vec").take(pa.array(at)), int(d)))
                if int(d) in books and q.dtype != object:
                    cells[at] = books[int(d)].cells(q)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "vec")), pa.array(cells)], names=["id", "label", "vec", "cell"])
    return run


def _blocks(batches, books: dict[int, Books]):
    """Blocks of a partition, by length of the vectors."""
    held, n = [], 0

    def built():
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["id"].fill_null(_NO_ID).to_numpy()
        labels, cells = table["label"].to_numpy(), table["cell"].to_numpy()
        vec = table["vec"].combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        lengths = vec.value_lengths().to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            yield int(d), Block(whole(_matrix(vec.take(pa.array(at)), int(d))), ids[at], labels[at], cells[at], books.get(int(d)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield from built()
            held, n = [], 0
    if n:
        yield from built()


def _mined(shared, books: dict[int, Books], same: bool):
    """Best rows of every anchor of a chunk in one partition: (no, goal, id, score)."""
    def run(batches):
        chunk, wanted, prepared = shared.value, {}, {}
        for d, block in _blocks(batches, books):
            if d not in chunk:
                continue
            if d not in wanted:
                nos, ids, labels, x, goals = chunk[d]
                q = whole(x)
                prepared[d] = q, [_size(a) for a in q]
                wanted[d] = [[Best(*g) for g in goal] for goal in goals]
            nos, ids, labels, x, goals = chunk[d]
            search(block, *prepared[d], ids, labels, same, wanted[d])
        rows = [(int(no), g, int(i), int(s)) for d, found in wanted.items() for no, best in zip(chunk[d][0], found)
                for g, b in enumerate(best) for s, i in zip(b.scores, b.ids)]
        for k in range(0, len(rows), 10000):
            no, goal, i, s = map(np.array, zip(*rows[k:k + 10000]))
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(goal.astype(np.int32)), pa.array(i, mask=i == _NO_ID), pa.array(s)], names=["no", "goal", "id", "score"])
    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no", "goal").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` picks the anchors by the columns of ``vectors``.  An anchor's positives are the first
    ``positives`` other rows of its label; for each of them come the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * score <= high * positive_score``.  A score is the inner
    product of the vectors' components times 256, rounded down; higher scores come first, then smaller
    ids, a null id last.  Rows with a null label, a null vector or a null or non-finite component take no
    part.  Only vectors of one length are compared.  A row with the anchor's id is not another row;
    other repeated rows count as rows of their own, and a repeated anchor gives its result again.
    Anchors without positives, or positives without rows in their window, give no rows; an empty table
    gives none.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    wrong = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~wrong)
    mix = F.xxhash64("id", "label", "vec")

    width = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 1)
    double = F.col("vec").cast("array<double>").alias("vec")
    sample = rows.select(mix.alias("o"), double).orderBy("o").limit(min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // width))).collect()
    books: dict[int, Books] = {}
    for d in {len(r["vec"]) for r in sample}:
        own = [r["vec"] for r in sample if len(r["vec"]) == d]
        q = whole(np.array(own, dtype=np.float64).reshape(len(own), d))
        if d and q.dtype != object:
            books[d] = Books(q)

    kept = rows.select("id", "label", double).mapInArrow(_celled(books), "id long, label long, vec array<double>, cell int")
    index = kept.withColumn("mix", F.xxhash64("id", "label")).repartitionByRange("cell", "mix").sortWithinPartitions("cell").drop("mix")
    index = stored(index, "op13-index")
    anchors = rows.filter("anchor").select(F.monotonically_increasing_id().alias("no"), "id", "label", double)
    anchors = stored(anchors, "op13-anchors")
    chunks = max(1, -(-anchors.count() * width // CHUNK_VALUES))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("no"), F.lit(chunks)))

    found = None
    for c in range(chunks):  # each has at most about CHUNK_VALUES components and meets the whole index
        held = anchors.filter(F.col("chunk") == c).orderBy("no").collect()
        if not held:
            continue
        first = spark.sparkContext.broadcast(_chunk(held, {r["no"]: [(positives,)] for r in held}))
        best = _best(index.mapInArrow(_mined(first, books, True), "no long, goal int, id long, score long"), positives)
        best = stored(best.select("no", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "op13-positives")
        goals: dict[int, list] = {r["no"]: [] for r in held}
        for r in best.orderBy("no", "rank").collect():  # `positives` rows an anchor of the chunk
            p = r["positive_score"]
            goals[r["no"]].append((negatives, -(-low * p // 100), high * p // 100))
        second = spark.sparkContext.broadcast(_chunk(held, {no: g for no, g in goals.items()}))
        hard = _best(index.mapInArrow(_mined(second, books, False), "no long, goal int, id long, score long"), negatives)
        hard = hard.select("no", (F.col("goal") + 1).alias("p"), F.col("rank").alias("r"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        of = anchors.select("no", F.col("id").alias("anchor_id"))
        out = hard.join(best.withColumnRenamed("rank", "p"), ["no", "p"]).join(of, "no")
        out = stored(out.select("anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "op13-mined")
        found = out if found is None else found.union(out)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def _chunk(held: list, goals: dict) -> dict:
    """Anchors by length of their vectors: numbers, ids, labels, vectors, goals."""
    out = {}
    for d in {len(r["vec"]) for r in held}:
        rows = [r for r in held if len(r["vec"]) == d]
        ids = np.array([_NO_ID - 1 if r["id"] is None else r["id"] for r in rows], dtype=np.int64)
        out[d] = ([r["no"] for r in rows], ids, np.array([r["label"] for r in rows], dtype=np.int64),
                  np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), d), [goals[r["no"]] for r in rows])
    return out
