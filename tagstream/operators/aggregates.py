"""Aggregations (A1–A21) and the metric log (T2, T3 batch forms).

Every aggregate is a ``groupBy`` with map-side partial aggregation; "all groups at once, 0.0 when
empty" results are a left join of the computed groups onto the group spine (learners × the four
phase/kind combinations, the spine built by ``explode``, not by a cross join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions import text as TX
from tagstream.functions.scalar import md5_fraction
from tagstream.session import dimension, maybe_broadcast

F_SCALE = 50000
EPOCH = "1970-01-01 00:00:00"


def _f(units: Column, scale: int = F_SCALE) -> Column:
    return units / F.lit(float(scale))


# --- text → terms -----------------------------------------------------------------------------

def term_tokens(df: DataFrame, text_col: str, key: str = "question_id", drop_stop_words: bool = True) -> DataFrame:
    """Long form (key, term) of the whole text: F3 tokens, F4 stop words dropped."""
    toks = TX.tokens(F.col(text_col))
    if drop_stop_words:
        toks = TX.drop_stop(toks)
    return df.select(key, F.explode(toks).alias("term"))


def term_frequencies(df: DataFrame, text_col: str, key: str = "question_id", stem: bool = False) -> DataFrame:
    """A1: (key, term, freq).  With ``stem`` the F5 stems replace the terms: they are made of the distinct
    vocabulary and joined to the counted terms."""
    counted = term_tokens(df, text_col, key).groupBy(key, "term").agg(F.count(F.lit(1)).cast("int").alias("freq"))
    if not stem:
        return counted
    from tagstream.functions.porter import stem_terms

    counted = dimension(counted, "a1-counted")  # read for the vocabulary and for the join
    stems = dimension(stem_terms(counted), "a1-stems")
    return (counted.join(maybe_broadcast(stems), "term").groupBy(key, F.col("stem").alias("term"))
            .agg(F.sum("freq").cast("int").alias("freq")))


def vocabulary(df: DataFrame, col: str, out: str = "name") -> DataFrame:
    """A2: distinct values (an exploded array column or a plain one)."""
    dt = dict(df.dtypes)[col]
    c = F.explode(col) if dt.startswith("array") else F.col(col)
    return df.select(c.alias(out)).distinct()


# --- metric log -------------------------------------------------------------------------------

def metric_events(wide: DataFrame) -> DataFrame:
    """T2 (batch form): every scored instance → a general and a top-k row."""
    return wide.select(
        "learner", "question_id", "created_on", "is_prequential", "is_test", "duration_us",
        F.explode(F.array(
            F.struct(F.lit(0).alias("is_topk"), F.col("fm_units").alias("units")),
            F.struct(F.lit(1).alias("is_topk"), F.col("topk_units").alias("units")),
        )).alias("_kv"),
    ).select("learner", "question_id", "created_on", "is_prequential", "is_test", "duration_us",
             F.col("_kv.is_topk").alias("is_topk"), F.col("_kv.units").alias("units"))


def _phase_kind_spine(log: DataFrame, learner: str = "learner") -> DataFrame:
    combos = F.array(*[F.struct(F.lit(p).alias("is_prequential"), F.lit(k).alias("is_topk"))
                       for p in (0, 1) for k in (0, 1)])
    return log.select(learner).distinct().select(learner, F.explode(combos).alias("_c")).select(
        learner, "_c.is_prequential", "_c.is_topk")


def avg_f(log: DataFrame, scale: int = F_SCALE) -> DataFrame:
    """A3: average F per learner, phase and kind, test rows excluded; 0.0 for an empty group."""
    a = (log.filter(F.col("is_test") == 0).groupBy("learner", "is_prequential", "is_topk")
         .agg(F.avg("units").alias("_a")))
    spine = _phase_kind_spine(log)
    return spine.join(a, ["learner", "is_prequential", "is_topk"], "left").select(
        "learner", "is_prequential", "is_topk", F.coalesce(_f(F.col("_a"), scale), F.lit(0.0)).alias("avg_f"))


def avg_test_f(log: DataFrame, scale: int = F_SCALE) -> DataFrame:
    """A4: average F of the test rows per learner and kind; 0.0 when there are none."""
    a = log.filter(F.col("is_test") == 1).groupBy("learner", "is_topk").agg(F.avg("units").alias("_a"))
    spine = log.select("learner").distinct().select("learner", F.explode(F.array(F.lit(0), F.lit(1))).alias("is_topk"))
    return spine.join(a, ["learner", "is_topk"], "left").select(
        "learner", "is_topk", F.coalesce(_f(F.col("_a"), scale), F.lit(0.0)).alias("avg_test_f"))


def running_avg(log: DataFrame, scale: int = F_SCALE) -> DataFrame:
    """T3 (batch form): average F and count per learner, phase, kind (test rows excluded)."""
    return (log.filter(F.col("is_test") == 0).groupBy("learner", "is_prequential", "is_topk")
            .agg(_f(F.avg("units"), scale).alias("avg_f"), F.count(F.lit(1)).alias("n")))


def total_count(df: DataFrame) -> DataFrame:
    """A5."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def max_created(df: DataFrame, ts: str = "created_on") -> DataFrame:
    """Latest creation time, the epoch when the table is empty."""
    return df.agg(F.coalesce(F.max(ts), F.lit(EPOCH).cast("timestamp_ntz")).alias("max_created"))


def batch_dims(df: DataFrame, n_features: int, pos: str = "attr_index") -> DataFrame:
    """Max feature index + 1 and max label index + 1 of a batch of sparse rows."""
    is_label = F.col(pos) >= n_features
    return df.agg(
        (F.max(F.when(~is_label & (F.col(pos) > 0), F.col(pos))) + 1).alias("n_features"),
        (F.max(F.when(is_label, F.col(pos) - n_features)) + 1).alias("n_labels"),
    )


def dataset_dims(header: DataFrame, rows: DataFrame, prefix: str, key: str = "question_id") -> DataFrame:
    """Label, feature and instance counts (features exclude the id column)."""
    h = header.agg(F.count_if(F.col("name").startswith(prefix)).alias("n_labels"),
                   F.count(F.lit(1)).alias("n_attrs"))
    n_inst = rows.agg(F.count_distinct(key)).scalar()
    return h.select("n_labels", (F.col("n_attrs") - F.col("n_labels") - 1).alias("n_features"),
                    n_inst.alias("n_instances"))


def f_series(log: DataFrame, include_test: bool = False, scale: int = F_SCALE) -> DataFrame:
    """The four time-ordered F series per learner in long form (learner, series, pos, …).

    The position comes from a bucketed running count, so one learner's history is never gathered
    into a single list or task; ``series_arrays`` folds it into arrays for bounded API use.
    """
    from tagstream.operators.windows import category, prefix_aggregate

    d = log if include_test else log.filter(F.col("is_test") == 0)
    d = d.withColumn("series", category(F.col("is_prequential"), F.col("is_topk"))).withColumn(
        "_t", F.unix_micros(F.col("created_on").cast("timestamp")))
    d = prefix_aggregate(d, ["learner", "series"], ["_t", "question_id"], "_t", sums={"pos": F.lit(1)})
    return d.select("learner", "series", F.col("pos").cast("bigint").alias("pos"), "question_id", "created_on",
                    _f(F.col("units"), scale).alias("f"))


def series_arrays(series: DataFrame) -> DataFrame:
    """A9 as arrays: one ordered F list per (learner, series); for bounded histories only."""
    return series.groupBy("learner", "series").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda s: s["f"]).alias("fs"))


def pivot_phase_kind(avgs: DataFrame, value: str = "avg_f") -> DataFrame:
    """One row per learner with the four averages as columns."""
    key = F.concat(F.when(F.col("is_prequential") == 1, F.lit("preq")).otherwise(F.lit("post")), F.lit("_"),
                   F.when(F.col("is_topk") == 1, F.lit("topk")).otherwise(F.lit("general")))
    cols = ["preq_general", "preq_topk", "post_general", "post_topk"]
    return avgs.withColumn("_k", key).groupBy("learner").pivot("_k", cols).agg(F.first(value)).select(
        "learner", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def learner_summary(log: DataFrame, macro: DataFrame) -> DataFrame:
    """A10: macro F plus the four averages, one row per learner (``macro``: learner, macro_f)."""
    return pivot_phase_kind(avg_f(log)).join(maybe_broadcast(macro), "learner", "left")


def latest_vs_avg(log: DataFrame, scale: int = F_SCALE) -> DataFrame:
    """Per learner, phase and kind the newest instance's F beside the average (both partial
    aggregates: ``max_by`` on (created_on, question_id))."""
    d = log.filter(F.col("is_test") == 0)
    return d.groupBy("learner", "is_prequential", "is_topk").agg(
        _f(F.max_by("units", F.struct("created_on", "question_id")), scale).alias("latest_f"),
        _f(F.avg("units"), scale).alias("avg_f"))


def family_mean(runs: DataFrame, family: str, run: str, value: str) -> DataFrame:
    """Per family, the mean over runs of each run's final value (``runs`` holds one value per
    (family, run))."""
    return runs.groupBy(family).agg(F.round(F.avg(value), 9).alias("mean_value"), F.count(F.lit(1)).alias("n_runs"))


def tag_counts(qt: DataFrame, tag: str = "tag") -> DataFrame:
    return qt.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))


def top_tags(qt: DataFrame, n: int = 10, tag: str = "tag") -> DataFrame:
    """Most frequent tags, ties by name (TakeOrderedAndProject: top-n per partition, merged)."""
    return tag_counts(qt, tag).orderBy(F.col("n").desc(), F.col(tag)).limit(n)


def rare_tags(qt: DataFrame, n: int = 10, tag: str = "tag") -> DataFrame:
    """Least frequent tags."""
    return tag_counts(qt, tag).orderBy(F.col("n"), F.col(tag)).limit(n)


def cooccurrence(qt: DataFrame, set_a: DataFrame, set_b: DataFrame | None = None, key: str = "question_id",
                 tag: str = "tag") -> DataFrame:
    """Co-occurrence counts of tag pairs (a, b), a from ``set_a``, b from ``set_b`` (default:
    unordered pairs within ``set_a``), zero counts kept, for chosen sets of any size.

    No per-question pairs are emitted: each question's chosen tags become one sorted array, equal
    arrays are counted (partial aggregation), and pairs are expanded only on the distinct arrays.
    """
    same = set_b is None
    a_names = set_a.select(F.col(tag).alias("tag1")).distinct()
    b_names = (set_a if same else set_b).select(F.col(tag).alias("tag2")).distinct()
    chosen = a_names.union(b_names).distinct().withColumnRenamed("tag1", tag)
    sets = (qt.join(maybe_broadcast(chosen), tag, "left_semi")
            .groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias("_s")).filter(F.size("_s") > 1)
            .groupBy("_s").agg(F.count(F.lit(1)).alias("_n")))
    found = (sets.select("_n", "_s", F.explode("_s").alias("tag1")).select("_n", "tag1", F.explode("_s").alias("tag2"))
             .filter("tag1 <> tag2").groupBy("tag1", "tag2").agg(F.sum("_n").alias("_n")))
    # the requested pairs are the result itself: every name of one set beside those of the other
    others = b_names.agg(F.array_sort(F.collect_list("tag2"))).scalar()
    wanted = F.col("tag1") < F.col("tag2") if same else F.col("tag1") != F.col("tag2")
    pairs = a_names.select("tag1", F.explode(others).alias("tag2")).filter(wanted)
    counted = pairs.join(found, ["tag1", "tag2"], "left")
    return counted.select("tag1", "tag2", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n"))


def scaled_weight(df: DataFrame, c: str, out: str = "weight") -> DataFrame:
    """``(c − min) / (max − min)`` with min and max as scalar subqueries; null when max = min."""
    mm = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    lo = mm.select("lo").scalar()
    hi = mm.select("hi").scalar()
    return df.withColumn(out, (F.col(c) - lo).cast("double") / F.nullif(hi - lo, F.lit(0)).cast("double"))


def avg_times(log: DataFrame) -> DataFrame:
    """Average duration per learner, phase and kind."""
    return log.groupBy("learner", "is_prequential", "is_topk").agg(F.avg("duration_us").alias("avg_duration_us"))


def monthly_counts(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Counts per calendar month from ``start`` to ``end`` (inclusive), empty months kept.
    The month spine has one row per month of the span and is broadcast."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    counts = df.groupBy(F.date_trunc("month", F.col(ts)).cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("_n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("_n", F.lit(0)).alias("n"))


def user_tag_counts(df: DataFrame, user: str, tag: str) -> DataFrame:
    """Distinct tags per user (two-phase distinct aggregation)."""
    return df.groupBy(user).agg(F.count_distinct(tag).alias("n_tags"))


#: Bits of the registers' number of a distinct-count sketch, and how far estimates may be off (three standard errors).
SKETCH_BITS = 12
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def user_tag_sketches(df: DataFrame, user: str, day: Column, tag: str) -> DataFrame:
    """One mergeable distinct-count sketch per user and day, to be stored: later days add rows, and no
    day is counted again."""
    return df.groupBy(user, day.alias("day")).agg(F.hll_sketch_agg(tag, F.lit(SKETCH_BITS)).alias("sketch"))


def user_tag_counts_approx(sketches: DataFrame, user: str) -> DataFrame:
    """A19 from stored sketches: the days of a user merged, off by at most ``SKETCH_BOUND`` of the count."""
    return sketches.groupBy(user).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_tags"))


def sample_users(df: DataFrame, user: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` users: order by ``md5(id ‖ seed)``."""
    users = df.select(user).distinct()
    return users.withColumn("_h", F.md5(F.concat(F.col(user).cast("string"), F.lit(str(seed))))) \
        .orderBy("_h").limit(n).drop("_h")


def experiment_report(log: DataFrame, configs: DataFrame, cfg_cols: Sequence[str], key: str = "learner") -> DataFrame:
    """One row per parameter set with all averages (four F averages, average duration,
    instance count)."""
    d = log.filter(F.col("is_test") == 0).join(maybe_broadcast(configs), key)
    def avg_of(p, k):
        return _f(F.avg(F.when((F.col("is_prequential") == p) & (F.col("is_topk") == k), F.col("units"))))
    return d.groupBy(*cfg_cols).agg(
        F.coalesce(avg_of(1, 0), F.lit(0.0)).alias("preq_general"),
        F.coalesce(avg_of(1, 1), F.lit(0.0)).alias("preq_topk"),
        F.coalesce(avg_of(0, 0), F.lit(0.0)).alias("post_general"),
        F.coalesce(avg_of(0, 1), F.lit(0.0)).alias("post_topk"),
        F.avg("duration_us").alias("avg_duration_us"),
        F.count_distinct("question_id").alias("n_instances"),
    )


def bernoulli_split(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    """Repeatable train/test flag: ``md5(id ‖ seed)`` fraction < p."""
    return df.withColumn("is_test", (md5_fraction(F.col(key), F.lit(str(seed))) < p).cast("int"))
