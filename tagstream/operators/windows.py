"""Ordered window work (W1–W8, S2): record numbers, running sums, melt, chunks, newest-n.

Running sums and ranks over a key that may hold a large share of all rows are computed in two
levels: rows are split into range buckets of the order column (cut points from a quantile sketch, so
the bucket is a pure function of the value), the window runs per (key, bucket), and each bucket
gets the total of the earlier buckets of its key from a small table.  One hot key therefore spreads
over ``n_buckets`` tasks instead of one.

The input is computed once and written; cut points (the order column), bucket totals (the summed
columns) and windows read the written rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.session import dimension, maybe_broadcast, written

_UNB = Window.unboundedPreceding

#: Accuracy of the cut points: a bucket is off its equal share by at most a tenth of it.
_SKETCH_PER_BUCKET = 20


def _n_buckets(df: DataFrame, n: int | None) -> int:
    if n is not None:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order_bounds(df: DataFrame, col: str, n_buckets: int) -> list:
    """Quantile cut points of a numeric or time column, of its own type (a distributed aggregate;
    only the ``n_buckets - 1`` cut points reach the driver).  The sketch grows with the buckets."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.agg(F.percentile_approx(col, probs, _SKETCH_PER_BUCKET * n_buckets).alias("q")).first()["q"] or []
    return sorted({q for q in qs if q is not None and q == q})


def bucket_column(col: str | Column, bounds: Sequence) -> Column:
    """How many of the ascending ``bounds`` are at most ``col``, by binary search; 0 for a null."""
    c = F.col(col) if isinstance(col, str) else col
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, k: F.when(F.get(arr, low + k - 1) <= c, low + k).otherwise(low))


class Track(NamedTuple):
    """Running values of one grouping: sums (name → value expression) and dense ranks (name → column)
    per ``keys`` in the order of ``order``."""

    keys: Sequence[str]
    order: Sequence[str | Column]
    sums: dict[str, Column] = {}
    ranks: dict[str, str] = {}


def prefix_tracks(df: DataFrame, tracks: Sequence[Track], bucket_on: str, n_buckets: int | None = None,
                  inclusive: bool = True, is_written: bool = False) -> DataFrame:
    """Add the running values of all ``tracks``, over one set of range buckets of ``bucket_on``.

    ``bucket_on`` must be numeric or a time and the first component of every order (ranks / sums are
    then consistent across buckets).  Sums are frame ``unboundedPreceding..currentRow`` (``inclusive``)
    or ``..-1``.  Tracks whose keys contain those of another share its shuffle.  ``is_written`` says that
    ``df`` is cheap to read several times, so it is not written again.
    """
    rows = df if is_written else written(df, "prefix-rows")
    b = rows.withColumn("_b", bucket_column(bucket_on, order_bounds(rows, bucket_on, _n_buckets(df, n_buckets))))
    out, names = b, []
    for t in tracks:
        w = Window.partitionBy(*t.keys, "_b").orderBy(*t.order)
        frame = w.rowsBetween(_UNB, 0 if inclusive else -1)
        out = out.select("*", *[F.coalesce(F.sum(e).over(frame), F.lit(0)).alias(f"_l_{n}") for n, e in t.sums.items()],
                         *[F.dense_rank().over(w).alias(f"_l_{n}") for n in t.ranks])
    for t in tracks:
        part, own = [*t.keys, "_b"], [*t.sums, *t.ranks]
        total = b.groupBy(*part).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in t.sums.items()],
                                     *[F.count_distinct(F.struct(c)).alias(f"_t_{n}") for n, c in t.ranks.items()])  # a null is a rank
        before = Window.partitionBy(*t.keys).orderBy("_b").rowsBetween(_UNB, -1)
        off = total.select(*[F.col(c).alias(f"_k_{c}") for c in part],
                           *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in own])
        off = dimension(off, "prefix-offsets")
        # null-safe: rows with a null key or order value form groups of their own
        same = functools.reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
        out = out.join(maybe_broadcast(off), same).drop(*[f"_k_{c}" for c in part])
        names += own
    added = [(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    return out.select(*[c for c in rows.columns if c not in names], *added)


def prefix_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str | Column],
    bucket_on: str,
    sums: dict[str, Column] | None = None,
    dense_rank_of: dict[str, str] | None = None,
    n_buckets: int | None = None,
    inclusive: bool = True,
    is_written: bool = False,
) -> DataFrame:
    """One track: running ``sums`` and dense ranks (``dense_rank_of``) per ``keys`` in ``order_cols`` order."""
    track = Track(list(keys), list(order_cols), sums or {}, dense_rank_of or {})
    return prefix_tracks(df, [track], bucket_on, n_buckets, inclusive, is_written)


# ---------------------------------------------------------------------------------------------
# Melt of the wide metric log into the long report
# ---------------------------------------------------------------------------------------------

# Report category names of the melted result rows.
CATEGORY_PREQ_GENERAL = "prequential general"
CATEGORY_PREQ_TOPK = "prequential topk"
CATEGORY_POST_GENERAL = "post-training general"
CATEGORY_POST_TOPK = "post-training topk"

F_SCALE = 50000  # the fixture's F unit: 1/50000


def category(is_prequential: Column, is_topk: Column) -> Column:
    phase = F.when(is_prequential == 1, F.lit("prequential")).otherwise(F.lit("post-training"))
    kind = F.when(is_topk == 1, F.lit("topk")).otherwise(F.lit("general"))
    return F.concat_ws(" ", phase, kind)


def record_id(df: DataFrame, learner: str = "learner", key: str = "question_id", out: str = "record_id",
              n_buckets: int | None = None) -> DataFrame:
    """Rank of the question id among the learner's distinct ids, from 1."""
    return prefix_aggregate(df, [learner], [key], key, dense_rank_of={out: key}, n_buckets=n_buckets)


def melt_long(df: DataFrame, include_test: bool = False) -> DataFrame:
    """W4 first half (U2): each wide row → a general and a top-k row, tagged with the category."""
    base = df if include_test else df.filter(F.col("is_test") == 0)
    extra = [c for c in ("record_id",) if c in base.columns]
    long = base.select(
        *extra, "learner", "question_id", "created_on", "is_prequential",
        F.explode(F.array(
            F.struct(F.lit(0).alias("is_topk"), F.col("fm_units").alias("units")),
            F.struct(F.lit(1).alias("is_topk"), F.col("topk_units").alias("units")),
        )).alias("_kv"),
    )
    keep = [c for c in ("record_id",) if c in base.columns]
    return long.select(
        *keep, "learner", "question_id", "created_on",
        category(F.col("is_prequential"), F.col("_kv.is_topk")).alias("category"),
        F.col("_kv.units").alias("units"),
    )


def melt_results(df: DataFrame, include_test: bool = False, scale: int = F_SCALE,
                 n_buckets: int | None = None) -> DataFrame:
    """W4 with W1–W3: RecordId, Learner, Category, CreatedOn, Fm, CumFm, Regret, CumRegret.

    The record id ranks the question among all distinct ids of the learner (every category);
    running sums are per (learner, category).  F is carried as integer units, summed exactly,
    and divided only at the end.
    """
    base = df if include_test else df.filter(F.col("is_test") == 0)
    units = {"g": F.col("fm_units"), "t": F.col("topk_units")}
    # the sums run over the wide rows, one per instance: a category is a phase and one of its two values
    base = base.select("learner", "question_id", "created_on", "fm_units", "topk_units",
                       F.coalesce(F.col("is_prequential") == 1, F.lit(False)).alias("_preq"))
    ranked = prefix_tracks(base, [
        Track(["learner"], ["question_id"], ranks={"record_id": "question_id"}),
        Track(["learner", "_preq"], ["question_id", "created_on"],
              {f"_cum_{k}": u for k, u in units.items()} | {f"_reg_{k}": F.lit(scale) - u for k, u in units.items()}),
    ], "question_id", n_buckets)
    long = ranked.select(
        "record_id", "learner", "created_on", "_preq",
        F.inline(F.array(*[F.struct(F.lit(int(k == "t")).alias("is_topk"), u.alias("units"), F.col(f"_cum_{k}").alias("cum"),
                                    F.col(f"_reg_{k}").alias("reg")) for k, u in units.items()])),
    )
    s = F.lit(float(scale))
    return long.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        "learner",
        category(F.col("_preq").cast("int"), F.col("is_topk")).alias("category"),
        "created_on",
        (F.col("units") / s).alias("fm"),
        (F.col("cum") / s).alias("cum_fm"),
        ((F.lit(scale) - F.col("units")) / s).alias("regret"),
        (F.col("reg") / s).alias("cum_regret"),
    )


def cumulative_f(df: DataFrame, f_col: str = "units", keys: Sequence[str] = ("learner", "category"),
                 order: Sequence[str] = ("question_id", "created_on"), n_buckets: int | None = None) -> DataFrame:
    """Running sum of F per (learner, category) in question order."""
    return prefix_aggregate(df, list(keys), list(order), order[0], sums={"cum_f": F.col(f_col)}, n_buckets=n_buckets)


def regret_of(f: Column, one: Column | int | float = 1) -> Column:
    """regret = 1 − F."""
    return (one if isinstance(one, Column) else F.lit(one)) - f


def regret(df: DataFrame, f_col: str = "units", scale: int = 1, keys: Sequence[str] = ("learner", "category"),
           order: Sequence[str] = ("question_id", "created_on"), n_buckets: int | None = None) -> DataFrame:
    """Regret and cumulative regret."""
    d = df.withColumn("regret", regret_of(F.col(f_col), scale))
    return prefix_aggregate(d, list(keys), list(order), order[0], sums={"cum_regret": F.col("regret")},
                            n_buckets=n_buckets)


def report_order(df: DataFrame) -> DataFrame:
    """O3: learner, category, created (code-point order)."""
    return df.orderBy("learner", "category", "created_on", "record_id")


# ---------------------------------------------------------------------------------------------
# W5, W6, W8, S2
# ---------------------------------------------------------------------------------------------

def cumulative_series(df: DataFrame, order_col: str, value: str, keys: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """1-based position and running sum of an ordered series (``order_col`` numeric, unique)."""
    return prefix_aggregate(df, list(keys), [order_col], order_col,
                            sums={"pos": F.lit(1), "cum_value": F.col(value)}, n_buckets=n_buckets)


def chunk_no(df: DataFrame, order_col: str, size: int, n_buckets: int | None = None) -> DataFrame:
    """Chunk number ⌊(rn − 1) / size⌋ of each instance in ``order_col`` order."""
    d = prefix_aggregate(df, [], [order_col], order_col, sums={"rn": F.lit(1)}, n_buckets=n_buckets)
    return d.withColumn("chunk_no", F.floor((F.col("rn") - 1) / F.lit(size)).cast("bigint"))


def newest_n(df: DataFrame, key: str | Sequence[str], ts: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """The newest ``n`` rows per key.  ``row_number() <= n`` is planned as a per-partition
    group limit before the shuffle, so a hot key never ships more than ``n`` rows per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def page_sample(df: DataFrame, ts: str, key: str, page_size: int = 100, stride: int = 10) -> DataFrame:
    """Per UTC day, rows ordered by (ts, key); page = ⌊(rn − 1) / size⌋; keep every
    ``stride``-th page starting at the first.  The window is per day; a hot day is split by the
    bucketed prefix count."""
    d = df.withColumn("_day", F.to_date(F.col(ts))).withColumn("_tsl", F.unix_micros(F.col(ts).cast("timestamp")))
    d = prefix_aggregate(d, ["_day"], ["_tsl", key], "_tsl", sums={"_rn": F.lit(1)})
    d = d.withColumn("page", F.floor((F.col("_rn") - 1) / F.lit(page_size)).cast("bigint"))
    return d.filter(F.col("page") % stride == 0).drop("_day", "_tsl", "_rn")
