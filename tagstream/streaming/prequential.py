"""Prequential evaluation (M17): score each batch, train on it, score it again, log both phases.

A micro-batch runs as Spark jobs over its chunks of the feed, one chunk a batch; the model's versions and the
metric rows are Parquet tables in the shared checkpoint folder, published together per batch in a commit
log, so ``foreachBatch`` over the T1 feed resumes from the last published batch after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.operators import aggregates as A
from tagstream.operators import multilabel as ML
from tagstream.operators import packed
from tagstream.operators import quality as Q
from tagstream.session import dimension
from tagstream.streaming.commits import CommitLog
from tagstream.streaming.feed import drained, each_batch, write_feed

WEIGHTS = "node bigint, bucket int, w double"
LOG_SCHEMA = ("learner string, question_id long, created_on timestamp_ntz, is_prequential int, is_test int, "
              "is_topk int, units long")


def prepared(questions: DataFrame, labels: DataFrame, tree: DataFrame, hd: int, k_tree: int) -> DataFrame:
    """question_id, created_on, packed features and node examples, and the labels, of each row of ``questions``:
    all that a batch needs and no batch changes."""
    feats = ML.hash_features(A.term_frequencies(questions, "text"), hd)
    rows = packed.pack(feats, questions, ML.node_examples(labels, questions, tree, k_tree))
    own = ML.label_vectors(labels.select("question_id", "tag_index")).withColumnRenamed("labels", "tags")
    return questions.select("question_id", "created_on").join(rows, "question_id").join(own, "question_id", "left")


def _predicted(scores: DataFrame, topk: int, threshold: float, is_prequential: int) -> DataFrame:
    """Labels of the general (probability ≥ threshold) and of the top-k kind."""
    keys = ["chunk_no", "question_id"]
    general = scores.filter(F.col("prob") >= threshold).select(*keys, "tag_index", F.lit(0).alias("is_topk"))
    top = Q.topk_labels(scores, topk, keys, score="prob").select(*keys, "tag_index", F.lit(1).alias("is_topk"))
    return general.unionByName(top).withColumn("is_prequential", F.lit(is_prequential))


def _logged(batch: DataFrame, pre: DataFrame, post: DataFrame, learner: str) -> DataFrame:
    """chunk_no and the T2 rows of both phases and kinds, in one pass over what was predicted."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("is_prequential"), F.lit(k).alias("is_topk")) for p in (1, 0) for k in (0, 1)]))
    questions = batch.select("chunk_no", "question_id", "created_on", each.alias("c")).select("chunk_no", "question_id", "created_on", "c.*")
    once = batch.dropDuplicates(["chunk_no", "question_id"])
    truth = once.select("chunk_no", "question_id", "tags", each.alias("c")).select("chunk_no", "question_id", "c.*", F.explode("tags").alias("tag_index"))
    keys = ["chunk_no", "is_prequential", "is_topk"]
    f = Q.instance_f(pre.unionByName(post), truth, questions, label="tag_index", keys=keys)
    return questions.join(f, [*keys, "question_id"]).select(
        "chunk_no", F.lit(learner).alias("learner"), "question_id", "created_on", "is_prequential", F.lit(0).alias("is_test"), "is_topk",
        F.round(F.col("f") * 50000).cast("long").alias("units"))


def _rate(epochs: int):
    """Step size of an epoch of a batch."""
    return lambda number, epoch: 1.0 / (1.0 + number * epochs + epoch)


def read_model(spark: SparkSession, log_path: str, batch_id: int) -> DataFrame:
    """(node, bucket, w) after a published batch (none before the first).

    The last batch of a micro-batch has its weights as a table.  Those of the batches inside it are the ones in
    front of the micro-batch after the steps since, which are taken again over the feed's rows."""
    if batch_id < 0:
        return ML.empty_weights(spark)
    record = CommitLog(spark, log_path).read(batch_id)
    if record is None:
        raise FileNotFoundError(f"the model of the batch before {batch_id + 1} is missing in {log_path}")
    if "model" in record:
        return spark.read.schema(WEIGHTS).parquet(record["model"])
    width = record["width"]
    held = packed.held_weights(read_model(spark, log_path, record["first"] - 1), record["nodes"], width)
    rows = spark.read.parquet(record["feed"]).filter(F.col("chunk_no").between(record["first"], batch_id))
    return packed.last_weights(packed.sequence(rows, held, _rate(record["epochs"]), record["epochs"]), width)


def _learn(batch: DataFrame, tree: DataFrame, size: tuple[int, int, int], width: int, model_path: str, log_path: str, learner: str,
           batch_id: int, k_tree: int, epochs: int, topk: int, threshold: float, held: dict) -> None:
    """M17 for one prepared batch, whose questions are spread.  ``held`` has the dense weights of the model written
    last, if they are one block."""
    spark = batch.sparkSession
    log = CommitLog(spark, log_path)
    if log.read(batch_id) is not None:
        return
    start = read_model(spark, log_path, batch_id - 1)
    batch = batch.withColumn("chunk_no", F.lit(batch_id).cast("long"))
    nodes = size[1]
    one_block = packed.fits(nodes, width)

    def block_of(w: DataFrame, name) -> object:
        if one_block and name not in held:
            held.clear()
            held[name] = packed.dense(w, 0, nodes, width)
        return held.get(name)

    feats = batch.select("question_id", F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("values").alias("value")))).filter(F.col("bucket") != packed.BIAS)

    def scores(w: DataFrame, block) -> DataFrame:
        found = ML.score_needed(batch, feats, w, tree, k_tree, topk, threshold, rows=batch, size=size, width=width, held=block)
        return found.withColumn("chunk_no", F.lit(batch_id).cast("long"))

    w, block = start, block_of(start, batch_id - 1)
    pre = _predicted(scores(w, block), topk, threshold, 1)
    n_node = batch.select("question_id", F.explode("nodes").alias("node")).distinct().transform(ML.node_counts)
    record = {"model": CommitLog(spark, model_path).folder("versions", batch_id), "log": log.folder("rows", batch_id)}
    once, rate = batch.dropDuplicates(["question_id"]), _rate(epochs)
    for t in range(epochs):
        w = packed.step(once, n_node, w, nodes, rate(batch_id, t), width, held=block)
        path = record["model"] if t == epochs - 1 else f"{record['model']}-{t}"
        w.write.parquet(path)
        w = spark.read.schema(WEIGHTS).parquet(path)
        block = block_of(w, batch_id if t == epochs - 1 else path)
    if not epochs:
        w.write.parquet(record["model"])
    post = _predicted(scores(w, block), topk, threshold, 0)
    _logged(batch, pre, post, learner).drop("chunk_no").write.parquet(record["log"])
    log.publish(batch_id, record)


def _learn_in_turn(rows: DataFrame, tree: DataFrame, size: tuple[int, int, int], width: int, model_path: str, log_path: str, learner: str,
                   k_tree: int, epochs: int, topk: int, threshold: float, feed_path: str | None = None) -> None:
    """M17 for the small prepared batches ``chunk_no`` of ``rows``, one after another, in jobs over all of them:
    node models are spread over the tasks, each of which goes through the batches in turn; both phases are scored
    from the margins found on the way.  Every batch has a record of its own; without ``feed_path`` there is one batch."""
    spark, log = rows.sparkSession, CommitLog(rows.sparkSession, log_path)
    numbers = [n for n in sorted(r[0] for r in rows.select("chunk_no").distinct().collect()) if log.read(n) is None]
    if not numbers:
        return
    first, last = numbers[0], numbers[-1]
    held = packed.held_weights(read_model(spark, log_path, first - 1), size[1], width)
    rows = rows.filter(F.col("chunk_no") >= first)
    models = CommitLog(spark, model_path)
    steps, model, out = models.folder("steps", last), models.folder("versions", last), log.folder("rows", last)
    found = packed.sequence(rows, held, _rate(epochs), epochs)
    found.write.parquet(steps)
    found = spark.read.schema(found.schema).parquet(steps)
    packed.last_weights(found, width).write.parquet(model)
    stacks = packed.margins_of(found)
    pre, post = (_predicted(ML.score_needed(rows, None, None, tree, k_tree, topk, threshold, rows=stacks, size=size, width=width, margins=m), topk, threshold, p)
                 for m, p in (("pre", 1), ("post", 0)))
    _logged(rows, pre, post, learner).repartition("chunk_no").write.partitionBy("chunk_no").parquet(out)
    inside = {"feed": feed_path, "first": first, "epochs": epochs, "nodes": size[1], "width": width}
    for n in numbers:
        log.publish(n, {**({"model": model} if n == last else inside), "log": os.path.join(out, f"chunk_no={n}")})


def prequential_step(batch: DataFrame, labels: DataFrame, tree: DataFrame, model_path: str, log_path: str,
                     learner: str, batch_id: int, hd: int = 16384, k_tree: int = 2, epochs: int = 1,
                     topk: int = 5, threshold: float = 0.5) -> None:
    """M17 for one batch of questions (question_id, text, created_on): T2 rows of the
    prequential phase, M6 update of the model, T2 rows of the post-training phase.

    The new model and the batch's rows are published together in the commit log at ``log_path``; a
    batch that is replayed after that does nothing, one that failed before it starts from the model of
    the batch before."""
    spark = batch.sparkSession
    log = CommitLog(spark, log_path)
    if log.read(batch_id) is not None:
        return
    previous = read_model(spark, log_path, batch_id - 1)
    batch = batch.checkpoint(eager=True)  # the batch's own chunk of the feed, read once
    own = labels.join(batch.select("question_id"), "question_id", "left_semi")
    rows = dimension(prepared(batch, own, tree, hd, k_tree).withColumn("chunk_no", F.lit(batch_id).cast("long")), "prepared")
    width, size = packed.width_of(rows, previous if batch_id else None), ML.tree_params(tree)
    if packed.fits(size[1], width) and rows.count() * packed.row_bytes(rows) <= packed.BATCH_BYTES:
        _learn_in_turn(rows, tree, size, width, model_path, log_path, learner, k_tree, epochs, topk, threshold)
    else:
        _learn(rows, tree, size, width, model_path, log_path, learner, batch_id, k_tree, epochs, topk, threshold, {})


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The logged rows of all published batches (none before the first)."""
    log = CommitLog(spark, log_path)
    paths = [log.read(n)["log"] for n in log.numbers()]
    return spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def prequential_stream(spark: SparkSession, feed_path: str, labels: DataFrame, tree: DataFrame, model_path: str, log_path: str,
                       learner: str, checkpoint: str, **kw):
    """M17 as a stream over the micro-batches of the T1 feed."""
    def run(df: DataFrame, batch_id: int) -> None:
        prequential_step(df.select("question_id", "text", "created_on"), labels, tree, model_path, log_path, learner, batch_id, **kw)

    return each_batch(spark, feed_path, run, checkpoint)


def prequential_replay(questions: DataFrame, labels: DataFrame, tree: DataFrame, root: str, learner: str,
                       batch_size: int, hd: int = 16384, k_tree: int = 2, epochs: int = 1, topk: int = 5, threshold: float = 0.5) -> DataFrame:
    """M17 over a whole table: the questions become an ordered feed (T1) of ``batch_size`` rows a chunk,
    whose micro-batches read their own chunk only.  Started again on the same ``root``, it goes on.

    Features, node examples and labels are made once for all questions (whose ids are distinct) and are what
    the feed holds, so a micro-batch scores, trains and scores again, and never reads the tables.  It takes as many
    small batches as ``packed.ROUND_BYTES`` of features hold; a batch above ``packed.BATCH_BYTES``, or any for a
    tree of several blocks, is a micro-batch of its own."""
    spark = questions.sparkSession
    feed_path = os.path.join(root, "feed")
    if not CommitLog(spark, feed_path).numbers():
        write_feed(prepared(questions.select("question_id", "text", "created_on"), labels, tree, hd, k_tree), feed_path, batch_size)
    model_path, log_path = os.path.join(root, "model"), os.path.join(root, "log")
    feed = spark.read.parquet(feed_path)
    size, width, held = ML.tree_params(tree), packed.width_of(feed), {}
    batch_bytes = batch_size * packed.row_bytes(feed)
    in_turn = packed.fits(size[1], width) and batch_bytes <= packed.BATCH_BYTES

    def run(df: DataFrame, micro_batch: int) -> None:
        if in_turn:
            _learn_in_turn(df, tree, size, width, model_path, log_path, learner, k_tree, epochs, topk, threshold, feed_path)
        else:
            _learn(df, tree, size, width, model_path, log_path, learner, micro_batch, k_tree, epochs, topk, threshold, held)

    chunks = max(1, int(packed.ROUND_BYTES // max(batch_bytes, 1))) if in_turn else 1
    drained(each_batch(spark, feed_path, run, os.path.join(root, "mark"), chunks_per_trigger=chunks))
    return read_log(spark, log_path)
