"""Quality metrics, thresholds and votes.

Set metrics are computed from (question, label) rows with joins and counts, never by collecting
label sets per question; per-label work runs over score *bins* so a frequent label is a bounded
number of rows after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.operators.windows import prefix_aggregate
from tagstream.session import maybe_broadcast


def _flags(pred: DataFrame, truth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per distinct (cols) with p = predicted, t = true (0/1)."""
    u = pred.select(*cols, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(
        truth.select(*cols, F.lit(0).alias("_p"), F.lit(1).alias("_t")))
    return u.groupBy(*cols).agg(F.max("_p").alias("p"), F.max("_t").alias("t"))


def instance_f(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None, key: str = "question_id",
               label: str = "tag", keys: Sequence[str] = ()) -> DataFrame:
    """M7: per question F = 2·|y ∩ ŷ| / (|y| + |ŷ|); 1.0 when both sets are empty (questions
    without any row come from ``questions``)."""
    keys = list(keys)
    fl = _flags(pred, truth, keys + [key, label])
    per_q = fl.groupBy(*keys, key).agg(
        F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))
    if questions is not None:
        per_q = questions.select(*keys, key).distinct().join(per_q, keys + [key], "left").fillna(
            0, subset=["tp", "n_pred", "n_true"])
    denom = F.col("n_pred") + F.col("n_true")
    f = F.when(denom == 0, F.lit(1.0)).otherwise((2 * F.col("tp")).cast("double") / denom)
    return per_q.select(*keys, key, f.alias("f"))


def label_counts(pred: DataFrame, truth: DataFrame, key: str = "question_id", label: str = "tag",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Per label TP / FP / FN and F = 2TP / (2TP + FP + FN)."""
    keys = list(keys)
    fl = _flags(pred, truth, keys + [key, label])
    c = fl.groupBy(*keys, label).agg(
        F.sum(F.col("p") * F.col("t")).alias("tp"),
        F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"),
        F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    return c.withColumn("f", (2 * F.col("tp")).cast("double") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f(pred: DataFrame, truth: DataFrame, key: str = "question_id", label: str = "tag",
            keys: Sequence[str] = ()) -> DataFrame:
    """Macro F = mean over labels of the per-label F (labels seen in truth or prediction)."""
    keys = list(keys)
    lc = label_counts(pred, truth, key, label, keys)
    agg = lc.groupBy(*keys) if keys else lc.groupBy()
    return agg.agg(F.round(F.avg("f"), 9).alias("macro_f"))


def topk_labels(scores: DataFrame, k: int, key: str | Sequence[str] = "question_id", label: str = "tag_index",
                score: str = "score") -> DataFrame:
    """The ``k`` best labels per question, ties by label; ``rank`` from 1.  The
    ``row_number() <= k`` filter is planned as a group limit before the shuffle."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(score).desc(), F.col(label))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tune_thresholds(scored: DataFrame, label: str = "tag_index", score: str = "score", y: str = "y") -> DataFrame:
    """Per label the cut s maximising 2·TP(≥ s) / (N(≥ s) + P); ties in F go to the higher
    cut.  Rows are first reduced to counts of each (label, score); the running sums over a label's
    scores are two-level, so a label with many distinct scores is spread over tasks.  A row without a
    score reaches no cut and counts in P only."""
    counts = scored.groupBy(label, score).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("tp")).checkpoint(eager=True)
    down = counts.filter(F.col(score).isNotNull()).withColumn("_down", -F.col(score))
    c = prefix_aggregate(down, [label], ["_down"], "_down", {"cum_tp": F.col("tp"), "cum_n": F.col("n")}, is_written=True)
    pos = counts.groupBy(F.col(label).alias("_label")).agg(F.sum("tp").alias("n_pos"))
    c = c.join(maybe_broadcast(pos), F.col(label).eqNullSafe(F.col("_label")))
    c = c.withColumn("f", (2 * F.col("cum_tp")).cast("double") / (F.col("cum_n") + F.col("n_pos")))
    best = c.groupBy(label).agg(F.max_by(F.struct("f", score), F.struct("f", score)).alias("_b"))
    return best.select(label, F.col(f"_b.{score}").alias("threshold"), F.col("_b.f").alias("best_f"))


def positive_labels(scores: DataFrame, thresholds: DataFrame, label: str = "tag_index", score: str = "score",
                    threshold: str = "threshold") -> DataFrame:
    """Labels whose score reaches the label's threshold (thresholds: one row per label)."""
    t = maybe_broadcast(thresholds.select(label, threshold))
    return scores.join(t, label).filter(F.col(score) >= F.col(threshold)).drop(threshold)


def ensemble_vote(votes: DataFrame, mode: str = "MV", weights: DataFrame | None = None, key: str = "question_id",
                  member: str = "member", label: str = "tag", weight: str = "weight") -> DataFrame:
    """MV = more than half of the members; FM / LCW = more than half of the total member
    weight (FM: the member's F, LCW: a given weight column)."""
    v = votes.select(key, member, label).distinct()
    if mode == "MV":
        total = votes.agg(F.count_distinct(member)).scalar()
        g = v.groupBy(key, label).agg(F.count(F.lit(1)).alias("_s"))
        return g.filter(F.col("_s") * 2 > total).select(key, label)
    if weights is None:
        raise ValueError(f"mode {mode} needs member weights")
    w = maybe_broadcast(weights.select(member, weight))
    total = weights.agg(F.sum(weight)).scalar()
    g = v.join(w, member).groupBy(key, label).agg(F.sum(weight).alias("_s"))
    return g.filter(F.col("_s") * 2 > total).select(key, label)


def _member_hits(votes: DataFrame, truth: DataFrame, by: str, member: str, key: str, label: str) -> DataFrame:
    """(member, ``by``): n_pred, tp and n_true; only predicted rows meet the truth, which is not
    copied for each member.  n_true is 0 where the truth has nothing."""
    v = votes.select(member, key, label).distinct()
    t = truth.select(key, label).distinct()
    hits = v.join(t.withColumn("_t", F.lit(1)), [key, label], "left").groupBy(member, by).agg(
        F.count(F.lit(1)).alias("n_pred"), F.count("_t").alias("tp"))
    return hits.join(t.groupBy(by).agg(F.count(F.lit(1)).alias("n_true")), by, "left").fillna(0, subset=["n_true"]).withColumn(
        "f", (2 * F.col("tp")).cast("double") / (F.col("n_pred") + F.col("n_true")))


def member_macro_f(votes: DataFrame, truth: DataFrame, member: str = "member", key: str = "question_id", label: str = "tag") -> DataFrame:
    """M12 by label: each member's macro F over the labels that it predicts or that the truth has;
    a label of the truth that it never predicts counts with F = 0."""
    n_labels = truth.agg(F.count_distinct(label)).scalar()
    own = F.sum((F.col("n_true") == 0).cast("int"))
    return _member_hits(votes, truth, label, member, key, label).groupBy(member).agg(
        F.round(F.sum("f") / (own + n_labels), 9).alias("quality"))


def member_avg_f(votes: DataFrame, truth: DataFrame, questions: DataFrame, member: str = "member", key: str = "question_id",
                 label: str = "tag") -> DataFrame:
    """M12 by instance: each member's F averaged over ``questions``; without its prediction a
    question counts 0, or 1 where the truth is empty too."""
    q = questions.select(key).distinct()
    v, t = votes.join(q, key, "left_semi"), truth.join(q, key, "left_semi")
    n_q = q.agg(F.count(F.lit(1))).scalar()
    with_truth = t.agg(F.count_distinct(key)).scalar()
    own = F.sum((F.col("n_true") == 0).cast("int"))
    return _member_hits(v, t, key, member, key, label).groupBy(member).agg(
        F.round((F.sum("f") + n_q - with_truth - own) / n_q, 9).alias("quality"))


def retain_members(members: DataFrame, fraction: float, n_min: int, group: str, member: str, n_rows: str,
                   score: str) -> DataFrame:
    """Within each ensemble (``group``), members with ≥ ``n_min`` training rows are ranked by
    score (ties by id); the best ⌈fraction · eligible⌉ stay active, the other eligible ones are set
    inactive, younger members stay active.  Windows are per ensemble (bounded by its size)."""
    elig = F.col(n_rows) >= n_min
    w = Window.partitionBy(group, elig).orderBy(F.col(score).desc(), F.col(member))
    d = members.withColumn("_rank", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(group, elig)))
    keep = ~elig | (F.col("_rank") <= F.ceil(F.col("_n") * F.lit(fraction)))
    return d.withColumn("is_active", keep.cast("int")).drop("_rank", "_n")
