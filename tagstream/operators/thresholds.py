"""Online F-measure thresholds (M14): the recurrence of a label, replayed by blocks.

A label's threshold in front of a row is a / b.  The decision is ŷ = [score ≥ a / b]; then a += y·ŷ and
b += y + ŷ.  That is sequential within a label, but most decisions do not need the exact threshold:

1. Rows are cut into blocks (``blocks.py``).  Between what is decided for sure and what is open, a / b in
   front of a row lies in an interval: it is greatest if of the open rows before it exactly those with
   y = 1 are called positive, least if exactly those with y = 0 are.  Scores outside the interval are
   decided in parallel, in all blocks at once; their totals narrow the intervals of the next round.
2. What stays open after the rounds is replayed in order per label, from a list of open rows and the
   totals between them, which gives each block its exact a and b.
3. With these every block is replayed on its own, in parallel.

a and b are whole numbers and a division is rounded monotonously, so the intervals hold exactly and the
result equals the plain loop's.  Labels of one block go to step 3 at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.operators.blocks import carried, in_blocks
from tagstream.session import dimension, write_bucketed

# Initial online threshold state a / b.
A0, B0 = 1, 2

#: Rounds of narrowing at most; they end when a round decides less than a tenth of what is open.
ROUNDS = 8
_INNER = 32

OUT = "tag_index int, question_id long, score double, y int, threshold double, y_hat int"
_TOTALS = ("a", "b", "open1", "open0")
_SUMS = "tag_index int, block long, a long, b long, open1 long, open0 long"


def steps(scores: np.ndarray, ys: np.ndarray, a: float, b: float):
    """The recurrence over rows in order: (thresholds, decisions, a, b after them)."""
    thresholds, decisions = np.empty(len(scores)), np.empty(len(scores), dtype=np.int32)
    for i, (s, y) in enumerate(zip(scores.tolist(), ys.tolist())):
        t = a / b
        h = 1 if s >= t else 0
        thresholds[i], decisions[i] = t, h
        a += y * h
        b += y + h
    return thresholds, decisions, a, b


def _before(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x) - x


def narrowed(scores: np.ndarray, ys: np.ndarray, a: int, b: int, open1: int, open0: int) -> np.ndarray:
    """Decisions of a block's rows, -1 where open, given what is decided and open in front of it."""
    decided = np.full(len(scores), -1, dtype=np.int64)
    for _ in range(_INNER):
        one, free = decided == 1, decided == -1
        sure_a, sure_b = a + _before(ys * one), b + _before(ys + one)
        more1, more0 = open1 + _before(free & (ys == 1)), open0 + _before(free & (ys == 0))
        high, low = (sure_a + more1) / (sure_b + more1), sure_a / (sure_b + more0)
        up, down = free & (scores >= high), free & (scores < low)
        if not (up | down).any():
            break
        decided[up], decided[down] = 1, 0
    return decided


def _arrays(batch: pa.RecordBatch):
    """(scores, labels of truth) of each block."""
    lengths = batch.column("rows").value_lengths().to_numpy()
    flat = batch.column("rows").flatten()
    scores = flat.field("score").to_numpy(zero_copy_only=False)
    ys = flat.field("y").to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(lengths)[:-1]
    return zip(np.split(scores, cuts), np.split(ys, cuts)) if batch.num_rows else ()


def _entries(batch: pa.RecordBatch, names):
    return zip(*(batch.column(c).to_pylist() for c in names)) if batch.num_rows else ()


def _narrow(batches):
    for batch in batches:
        rows = []
        for (s, y), entry in zip(_arrays(batch), _entries(batch, _TOTALS)):
            d = narrowed(s, y, *entry)
            rows.append((int((y * (d == 1)).sum()), int((y + (d == 1)).sum()), int(((d == -1) & (y == 1)).sum()), int(((d == -1) & (y == 0)).sum())))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("tag_index"), batch.column("block"), *(pa.array(list(c), pa.int64()) for c in cols)], names=["tag_index", "block", *_TOTALS])


_GAP = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("y", pa.int64())]))


def _open_rows(batches):
    """Of each block the open rows, each with what is decided since the one before it; a last entry
    without a score has what follows."""
    for batch in batches:
        out = []
        for (s, y), entry in zip(_arrays(batch), _entries(batch, _TOTALS)):
            d = narrowed(s, y, *entry)
            at = np.flatnonzero(d == -1)
            sure_a, sure_b = np.cumsum(y * (d == 1)), np.cumsum(np.where(d == -1, 0, y + (d == 1)))
            ends = np.append(at, len(s) - 1)
            a, b = np.diff(sure_a[ends], prepend=0), np.diff(sure_b[ends], prepend=0)
            out.append([{"a": int(p), "b": int(q), "score": float(s[k]), "y": int(y[k])} for p, q, k in zip(a, b, at)]
                       + [{"a": int(a[-1]), "b": int(b[-1]), "score": None, "y": None}])
        yield pa.RecordBatch.from_arrays([batch.column("tag_index"), batch.column("block"), batch.column("a0"), batch.column("b0"), pa.array(out, _GAP)],
                                         names=["tag_index", "block", "a0", "b0", "gaps"])


def _replay(batches):
    """Blocks of a label in order to the exact a and b in front of each."""
    label, a, b = None, 0, 0
    for batch in batches:
        out = []
        for tag, block, a0, b0, gaps in zip(*(batch.column(c).to_pylist() for c in ("tag_index", "block", "a0", "b0", "gaps"))):
            if tag != label:
                label, a, b = tag, a0, b0
            out.append((tag, block, a, b))
            for g in gaps:
                a, b = a + g["a"], b + g["b"]
                if g["score"] is not None:
                    h = 1 if g["score"] >= a / b else 0
                    a, b = a + g["y"] * h, b + g["y"] + h
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["tag_index", "block", "a", "b"])


def _exact(batches):
    for batch in batches:
        lengths = batch.column("rows").value_lengths().to_numpy()
        flat = batch.column("rows").flatten()
        found = [steps(s, y, a, b)[:2] for (s, y), (a, b) in zip(_arrays(batch), _entries(batch, ("a", "b")))]
        if not found:
            continue
        tags = np.repeat(batch.column("tag_index").to_numpy(), lengths)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tags), flat.field("question_id"), flat.field("score"), flat.field("y"), pa.array(np.concatenate([t for t, _ in found])), pa.array(np.concatenate([h for _, h in found]))],
            names=["tag_index", "question_id", "score", "y", "threshold", "y_hat"])


def thresholds(scored: DataFrame, entry: DataFrame | None = None, bits: int | None = None) -> DataFrame:
    """(tag_index, question_id, score, y, threshold, y_hat) of ``scored`` (tag_index, question_id, score,
    y), each label in the order of question_id, then score and y: the threshold in front of each row and the
    decision by it.  ``entry`` (tag_index, a, b) is where labels start, else at 1 / 2.  Rows with a null
    label, score or y take no part."""
    spark = scored.sparkSession
    rows = scored.select(F.col("tag_index").cast("int").alias("tag_index"), F.col("question_id").cast("long").alias("question_id"),
                         F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"))
    rows = in_blocks(rows.dropna(subset=["tag_index", "score", "y"]), ["tag_index"], ["question_id", "score", "y"], "m14-rows", bits)
    packed = rows.groupBy("tag_index", "block").agg(F.array_sort(F.collect_list(F.struct("at", "question_id", "score", "y"))).alias("rows"))
    packed = packed.withColumn("n", F.size("rows")).withColumn("ones", F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["y"]))
    # clustered by block, so the rounds join small per-block tables to it without moving the rows; the joins
    # hash these tables, as Spark might send the rows through the driver to broadcast them
    packed = write_bucketed(packed, "m14_blocks", int(spark.conf.get("spark.sql.shuffle.partitions")), ["tag_index", "block"])

    start = packed.select("tag_index").distinct()
    if entry is not None:
        start = start.join(entry.select("tag_index", F.col("a").cast("long").alias("a0"), F.col("b").cast("long").alias("b0")), "tag_index", "left")
        start = start.select("tag_index", F.coalesce("a0", F.lit(A0)).cast("long").alias("a0"), F.coalesce("b0", F.lit(B0)).cast("long").alias("b0"))
    else:
        start = start.select("tag_index", F.lit(A0).cast("long").alias("a0"), F.lit(B0).cast("long").alias("b0"))
    sizes = packed.groupBy("tag_index").agg(F.count("*").alias("blocks"))
    start = dimension(start.join(sizes, "tag_index"), "m14-start")
    several = start.filter("blocks > 1")
    first = start.filter("blocks = 1").join(packed.select("tag_index", "block"), "tag_index").select("tag_index", "block", F.col("a0").alias("a"), F.col("b0").alias("b"))

    hot = packed.join(several.select("tag_index"), "tag_index", "left_semi")
    totals = hot.select("tag_index", "block", F.lit(0).cast("long").alias("a"), F.col("ones").alias("b"), F.col("ones").alias("open1"), (F.col("n") - F.col("ones")).alias("open0"))
    totals = dimension(totals, "m14-totals")
    left = _left(totals)

    def entries(totals: DataFrame) -> DataFrame:
        e = carried(totals, ["tag_index"], _TOTALS).join(several, "tag_index")
        return e.select("tag_index", "block", (F.col("a") + F.col("a0")).alias("a"), (F.col("b") + F.col("b0")).alias("b"), "open1", "open0", "a0", "b0")

    for _ in range(ROUNDS if left else 0):
        totals = dimension(hot.join(entries(totals).hint("shuffle_hash"), ["tag_index", "block"]).mapInArrow(_narrow, _SUMS), "m14-totals")
        before, left = left, _left(totals)
        if 10 * left > 9 * before or not left:
            break
    gaps = hot.join(entries(totals).hint("shuffle_hash"), ["tag_index", "block"]).mapInArrow(
        _open_rows, "tag_index int, block long, a0 long, b0 long, gaps array<struct<a: long, b: long, score: double, y: long>>")
    exact = gaps.repartition("tag_index").sortWithinPartitions("tag_index", "block").mapInArrow(_replay, "tag_index int, block long, a long, b long")
    exact = dimension(exact.union(first), "m14-entries")
    return packed.join(exact.hint("shuffle_hash"), ["tag_index", "block"]).mapInArrow(_exact, OUT)


def _left(totals: DataFrame) -> int:
    """Rows that are open."""
    return totals.agg(F.sum(F.col("open1") + F.col("open0"))).first()[0] or 0
