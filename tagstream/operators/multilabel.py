"""Label-tree multi-label learning as Spark jobs.

Model: a complete k-ary *probabilistic label tree* (Jasinska et al., ICML 2016).  Each node holds a
logistic model of "some label below me is relevant, given that my parent's is"; a label's
probability is the product of the node probabilities on its root path.

Data layout (all long-form DataFrames):
  features  (question_id, bucket, value)       hashed bag of words
  labels    (question_id, tag_index)
  tree      (node, parent, depth, tag_index)
  weights   (node, bucket, w); bucket −1 holds the node bias

Training is full-batch gradient descent over packed questions (``packed.py``).  The long form of a step
(``train_matrix``, ``gradient_step``) is for weights that live in tables only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.functions.scalar import hash_bucket
from tagstream.operators import packed
from tagstream.session import checkpoint_dir, dimension, maybe_broadcast, scratch_path, write_bucketed


# --- features and labels -----------------------------------------------------------------------

def hash_features(tf: DataFrame, hd: int, key: str = "question_id", term: str = "term", freq: str = "freq") -> DataFrame:
    """M2: term counts hashed into ``hd`` buckets; colliding counts are added."""
    return tf.groupBy(key, hash_bucket(F.col(term), hd).alias("bucket")).agg(
        F.sum(freq).cast("bigint").alias("value"))


def label_vectors(qt_idx: DataFrame, key: str = "question_id", label: str = "tag_index") -> DataFrame:
    """M3: sorted label set of each question (bounded by the labels of one question)."""
    return qt_idx.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))


# --- the tree ----------------------------------------------------------------------------------

def n_internal(m: int, k: int) -> int:
    """Internal nodes of a complete k-ary tree with m leaves: ⌈(m − 1) / (k − 1)⌉."""
    return 0 if m <= 1 else -(-(m - 1) // (k - 1))


def _depth_expr(node: Column, k: int, max_depth: int) -> Column:
    # depth = number of levels d ≥ 1 whose first node (k^d − 1)/(k − 1) is ≤ node (integer exact)
    firsts = [sum(k ** j for j in range(d)) for d in range(1, max_depth + 1)]
    return F.size(F.filter(F.array(*[F.lit(v).cast("bigint") for v in firsts]), lambda f: f <= node))


def label_tree(tags: DataFrame, k: int = 2, label: str = "tag_index") -> DataFrame:
    """M4: node table of the complete k-ary tree over the labels: node 0 is the root,
    parent = ⌊(i − 1)/k⌋, leaf of label j = internal + j.  Only the label count reaches the
    driver; the nodes are a distributed ``range``."""
    spark = tags.sparkSession
    m = tags.count()
    internal = n_internal(m, k)
    total = internal + m
    max_depth = max(1, math.ceil(math.log(max(total, 2), k)) + 1)
    nodes = spark.range(total).select(F.col("id").alias("node"))
    return nodes.select(
        "node",
        F.when(F.col("node") == 0, F.lit(None)).otherwise(F.floor((F.col("node") - 1) / k)).cast("bigint").alias("parent"),
        _depth_expr(F.col("node"), k, max_depth).alias("depth"),
        F.when(F.col("node") >= internal, (F.col("node") - internal)).cast("int").alias(label),
    )


def ancestors(node: Column, k: int, max_depth: int) -> Column:
    """The root path of ``node`` as an array [node, parent, …, 0] (no join needed)."""
    step = lambda acc, _: F.when(F.element_at(acc, -1) > 0, F.concat(
        acc, F.array(F.floor((F.element_at(acc, -1) - 1) / k).cast("bigint")))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), F.array(node.cast("bigint")), step)


def tree_params(tree: DataFrame, label: str = "tag_index") -> tuple[int, int, int]:
    """(internal nodes, total nodes, depth) from the node table (one tiny aggregate)."""
    r = tree.agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("m"), F.max("depth").alias("d")).first()
    return int(r["n"] - r["m"]), int(r["n"]), int(r["d"] or 0)


def node_examples(qt_idx: DataFrame, questions: DataFrame, tree: DataFrame, k: int = 2, key: str = "question_id",
                  label: str = "tag_index") -> DataFrame:
    """M5: training rows per node.  A question reaches the root and every child of a node that
    holds one of its labels; ``y`` = the node holds one.  Rows per question are bounded by
    labels × depth × k."""
    internal, total, depth = tree_params(tree, label)
    pos = (qt_idx.select(key, F.explode(ancestors(F.col(label) + F.lit(internal), k, depth + 1)).alias("node"))
           .distinct())
    # children of positive internal nodes, plus the root for every question
    kids = pos.filter(F.col("node") < internal).select(
        key, F.explode(F.sequence(F.col("node") * k + 1, F.col("node") * k + k)).alias("node")).filter(
        F.col("node") < total)
    root = questions.select(key).distinct().withColumn("node", F.lit(0).cast("bigint"))
    reached = kids.unionByName(root).distinct()
    return reached.join(pos.withColumn("y", F.lit(1)), [key, "node"], "left").select(
        key, "node", F.coalesce("y", F.lit(0)).alias("y"))


# --- training ----------------------------------------------------------------------------------

BIAS_BUCKET = -1  # the node bias is the weight of a constant feature (bucket −1, value 1)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def with_bias(features: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Add the constant bias feature to every question (also those without any term)."""
    b = questions.select(key).distinct().select(key, F.lit(BIAS_BUCKET).alias("bucket"),
                                                F.lit(1).cast("bigint").alias("value"))
    return features.select(key, F.col("bucket").cast("int").alias("bucket"), "value").unionByName(b)


def train_matrix(examples: DataFrame, features: DataFrame, key: str = "question_id",
                 n_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """(question, node, y, bucket, value): the long training matrix, written once as a table
    bucketed by question and sorted by (question, node), so every epoch's margin window needs no
    shuffle (the scan reports the bucketing).  ``materialize=False`` returns the plain join, for a
    single pass where writing the table would cost more than it saves."""
    joined = examples.join(features, key)  # shuffle-joined on question: already clustered by it
    if not materialize:
        return joined
    n = n_partitions or int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(joined, "train_matrix", n, key, [key, "node"])


def _weights_side(weights: DataFrame, n_rows: int, row_bytes: int = 24, limit: int | None = None) -> DataFrame:
    from tagstream.session import BROADCAST_LIMIT_BYTES

    lim = BROADCAST_LIMIT_BYTES if limit is None else limit
    return F.broadcast(weights) if n_rows * row_bytes <= lim else weights


def gradient_step(matrix: DataFrame, n_node: DataFrame, weights: DataFrame, n_weights: int, lr: float,
                  key: str = "question_id") -> DataFrame:
    """One full-batch epoch; returns the new weights (bias included as bucket −1).

    margin(q, n) = Σ_b w[n, b]·x[q, b] (hash aggregate over the question-clustered matrix);
    g = σ(margin) − y;  w[n, b] −= lr · Σ_q g·x[q, b] / N_n  (one partially aggregated shuffle).
    The weights are broadcast when their measured size allows, else joined by shuffle.
    """
    w = _weights_side(weights, n_weights)
    # margins: hash aggregate per (question, node); the matrix is clustered by question, so no
    # exchange and no sort is needed
    margins = (matrix.join(w, ["node", "bucket"], "left")
               .groupBy(key, "node").agg(F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * F.col("value")).alias("_m"),
                                         F.max("y").alias("_y"))
               .select(key, "node", (_sigmoid(F.col("_m")) - F.col("_y")).alias("g")))
    # back onto the matrix with a shuffled hash join (both sides clustered by question)
    g = matrix.join(margins.hint("shuffle_hash"), [key, "node"])
    grad = g.groupBy("node", "bucket").agg(F.sum(F.col("g") * F.col("value")).alias("gw"))
    upd = grad.join(maybe_broadcast(n_node), "node").join(weights, ["node", "bucket"], "full_outer")
    return upd.select("node", "bucket", (F.coalesce(F.col("w"), F.lit(0.0))
                                         - F.lit(lr) * F.coalesce(F.col("gw") / F.col("n_node"), F.lit(0.0))).alias("w"))


def empty_weights(spark) -> DataFrame:
    return spark.createDataFrame([], "node bigint, bucket int, w double")


def node_counts(examples: DataFrame) -> DataFrame:
    """N_n: training rows per node (one row per tree node)."""
    return examples.groupBy("node").agg(F.count(F.lit(1)).alias("n_node"))


def train_nodes(examples: DataFrame, features: DataFrame, questions: DataFrame, epochs: int = 30,
                gamma: float = 1.0, lam: float = 1.0, key: str = "question_id") -> DataFrame:
    """M6: ``epochs`` full-batch steps with step size γ / (1 + λ·t) over packed questions (``packed.py``).
    Every epoch's weights are written to the shared checkpoint folder and read back, so lineage never
    grows and a lost executor costs one epoch at most."""
    spark = examples.sparkSession
    checkpoint_dir(spark)
    rows = packed.pack(features, questions, examples, key)
    n_node = dimension(node_counts(examples), "node-counts")
    nodes, width = (n_node.agg(F.max("node")).first()[0] or 0) + 1, packed.width_of(rows)
    rows = packed.stack(rows)
    w, run = None, scratch_path(spark, "weights")
    for t in range(epochs):
        # each epoch's weights are a Parquet table in the shared folder: reading it back starts
        # the next epoch from a plan with no lineage at all
        path = f"{run}/epoch={t}"
        packed.step(rows, n_node, w, nodes, gamma / (1.0 + lam * t), width, seen=t > 0).write.mode("overwrite").parquet(path)
        w = spark.read.parquet(path)
    return w if w is not None else empty_weights(spark)


# --- scoring -----------------------------------------------------------------------------------

def node_probabilities(frontier: DataFrame, features: DataFrame, weights: DataFrame, key: str = "question_id") -> DataFrame:
    """σ(margin) of each (question, node) in ``frontier`` (``features`` include the bias)."""
    dots = (frontier.select(key, "node").join(features, key).join(weights, ["node", "bucket"])
            .groupBy(key, "node").agg(F.sum(F.col("w") * F.col("value")).alias("_dot")))
    return (frontier.join(dots, [key, "node"], "left")
            .withColumn("p", _sigmoid(F.coalesce("_dot", F.lit(0.0)))).drop("_dot"))


def score_labels(questions: DataFrame, features: DataFrame, weights: DataFrame, tree: DataFrame,
                 k: int = 2, cut: float = 0.0, key: str = "question_id", label: str = "tag_index",
                 bound: DataFrame | None = None, beam: int | None = None) -> DataFrame:
    """M9: label probabilities = product of node probabilities on the root path, expanded level
    by level; a node whose running product falls below ``cut`` is not expanded (``cut = 0``
    scores every label).  Products are kept as sums of logs, and only fall along a path.

    ``bound`` (question, bound): nodes below their question's log bound are not expanded.  ``beam``
    expands the best nodes of each question and level only, for a first lower bound."""
    internal, total, depth = tree_params(tree, label)
    features = with_bias(features, questions, key)
    frontier = questions.select(key).distinct().withColumn("node", F.lit(0).cast("bigint")).withColumn(
        "logp", F.lit(0.0))
    done = None
    for _ in range(depth + 1):
        scored = node_probabilities(frontier, features, weights, key)
        scored = scored.withColumn("logp", F.col("logp") + F.log(F.greatest(F.col("p"), F.lit(1e-300)))).drop("p")
        if cut > 0:
            scored = scored.filter(F.col("logp") >= math.log(cut))
        if bound is not None:
            scored = scored.join(bound, key, "left").filter(F.col("bound").isNull() | (F.col("logp") >= F.col("bound"))).drop("bound")
        if beam is not None:
            best = Window.partitionBy(key).orderBy(F.col("logp").desc(), "node")
            scored = scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= beam).drop("_r")
        scored = scored.checkpoint(eager=True)  # cut the per-level lineage (shared folder)
        leaves = scored.filter(F.col("node") >= internal)
        done = leaves if done is None else done.unionByName(leaves)
        inner = scored.filter(F.col("node") < internal)
        frontier = inner.select(key, F.explode(F.sequence(F.col("node") * k + 1, F.col("node") * k + k)).alias("node"),
                                "logp").filter(F.col("node") < total)
    return done.select(key, (F.col("node") - internal).cast("int").alias(label), F.exp("logp").alias("prob"))


def score_needed(questions: DataFrame, features: DataFrame, weights: DataFrame, tree: DataFrame, tree_k: int, k: int,
                 low: float | None, key: str = "question_id", label: str = "tag_index", rows: DataFrame | None = None,
                 size: tuple[int, int, int] | None = None, width: int | None = None, held=None, margins: str | None = None) -> DataFrame:
    """Every label at or above ``low`` and the ``k`` best labels of each question, among others.

    Where the tree's weights fit into one block, each question's row is searched best node first.  For a
    larger tree the levels are joined: a beam finds k labels of each question; nothing below the least of
    them can be among the k best, and nothing below ``low`` can be positive, so what is below both is not
    expanded.

    ``rows`` (packed questions), ``size`` (of the tree), ``width`` and ``held`` (weights) may be given by a caller
    that has them already; with ``margins``, ``rows`` are stacks whose margins ``packed.sequence`` has found (column of
    ``packed.margins_of``), and the result has their chunk_no too."""
    internal, total, _ = size or tree_params(tree, label)
    if margins is not None:
        return packed.best_labels(rows, margins, internal, total, tree_k, k, low if low is not None else 0.0, ("chunk_no", key), label)
    rows = packed.pack(features, questions, key=key) if rows is None else rows
    width = packed.width_of(rows, weights) if width is None else width
    if packed.fits(total, width):
        return packed.search_labels(rows, weights, internal, total, tree_k, k, low if low is not None else 0.0, width, key, label, held)
    found = score_labels(questions, features, weights, tree, tree_k, key=key, label=label, beam=k)
    least = F.sort_array(F.collect_list("prob"), asc=False)  # at most k a level
    bound = found.groupBy(key).agg(least.alias("_p")).filter(F.size("_p") >= k).select(key, F.log(F.get("_p", F.lit(k - 1))).alias("bound"))
    floor = math.log(max(low if low is not None else 0.0, 1e-300))
    bound = bound.withColumn("bound", F.least("bound", F.lit(floor)) - 1e-9).checkpoint(eager=True)
    return score_labels(questions, features, weights, tree, tree_k, key=key, label=label, bound=bound)


def predict(questions: DataFrame, features: DataFrame, weights: DataFrame, tree: DataFrame,
            tags: DataFrame, tree_k: int = 2, k: int = 5, threshold: float | DataFrame = 0.5,
            key: str = "question_id", label: str = "tag_index") -> DataFrame:
    """Score (M9) → positive labels (M10: a global threshold or a per-label threshold table) and
    top-k (O5) → U3 → J6 decode, for all questions in one job.  Scoring is pruned exactly."""
    from tagstream.operators.quality import positive_labels, topk_labels
    from tagstream.operators.relational import decode_predictions

    low = threshold.agg(F.min("threshold")).first()[0] if isinstance(threshold, DataFrame) else threshold
    scores = score_needed(questions, features, weights, tree, tree_k, k, low, key, label)
    if isinstance(threshold, DataFrame):
        pos = positive_labels(scores, threshold, label, "prob")
    else:
        pos = scores.filter(F.col("prob") >= threshold)
    general = pos.groupBy(key).agg(F.collect_list(label).alias("general"))
    top = topk_labels(scores, k, key, label, "prob")
    topk = top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", label))), lambda s: s[label]).alias("topk"))
    sets = questions.select(key).distinct().join(general, key, "left").join(topk, key, "left").select(
        key, F.coalesce("general", F.array().cast("array<int>")).alias("general"),
        F.coalesce("topk", F.array().cast("array<int>")).alias("topk"))
    return decode_predictions(sets, tags, key)
