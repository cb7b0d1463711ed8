"""Filters (P3–P12), joins (J1–J12), set operations (U1–U6) and table writes (K1–K4).

Joins against a dimension (tags, vocabulary, configs, key lists) broadcast it only when the
optimizer's size estimate is below ``BROADCAST_LIMIT_BYTES`` (``maybe_broadcast``); otherwise they
shuffle and AQE re-plans with the measured size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.operators.indexing import assign_index
from tagstream.session import maybe_broadcast


# --- projections / filters -------------------------------------------------------------------

def by_key(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose key equals ``value`` (a literal or a scalar-subquery column)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.filter(F.col(col) == v)


def by_names(df: DataFrame, names: DataFrame, col: str = "name", names_col: str = "name") -> DataFrame:
    """Membership by names: a semi join (no IN-list chunking needed)."""
    n = names.select(F.col(names_col).alias("_n")).distinct()
    return df.join(maybe_broadcast(n), F.col(col) == F.col("_n"), "left_semi")


def by_indices(df: DataFrame, idx: DataFrame, col: str = "tag_index", idx_col: str = "tag_index") -> DataFrame:
    """P5: membership by indices."""
    i = idx.select(F.col(idx_col).alias("_i")).distinct()
    return df.join(maybe_broadcast(i), F.col(col) == F.col("_i"), "left_semi")


def metric_filter(df: DataFrame, learner: str | None = None, is_prequential: int | None = None,
                  is_topk: int | None = None, is_test: int | None = None) -> DataFrame:
    """Learner / phase / kind / test flags (pushed to the scan when the log is Parquet)."""
    cond = F.lit(True)
    for c, v in (("learner", learner), ("is_prequential", is_prequential), ("is_topk", is_topk),
                 ("is_test", is_test)):
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond)


def split_featurised(df: DataFrame, feats: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(already featurised, not yet featurised) rows of ``df``."""
    k = feats.select(key).distinct()
    return df.join(k, key, "left_semi"), df.join(k, key, "left_anti")


def classify_columns(header: DataFrame, prefix: str, pos: str = "attr_index", name: str = "name") -> DataFrame:
    """Role of each attribute: the first column is the id, names starting with the prefix are
    labels, the rest features."""
    first = header.agg(F.min(pos)).scalar()
    role = (F.when(F.col(pos) == first, F.lit("id"))
            .when(F.col(name).startswith(prefix), F.lit("label"))
            .otherwise(F.lit("feature")))
    return header.withColumn("role", role)


def split_sparse(df: DataFrame, n_features: int | Column, key: str = "question_id", pos: str = "attr_index",
                 val: str = "val") -> DataFrame:
    """Sparse entries → feature (index < n_features, position 0 is the id) or label
    (index − n_features)."""
    nf = n_features if isinstance(n_features, Column) else F.lit(n_features)
    is_label = F.col(pos) >= nf
    return df.filter(F.col(pos) != 0).select(
        key,
        F.when(is_label, F.lit("label")).otherwise(F.lit("feature")).alias("kind"),
        F.when(is_label, F.col(pos) - nf).otherwise(F.col(pos)).cast("int").alias("index"),
        F.col(val).alias("value"),
    )


def question_docs(q: DataFrame, qt: DataFrame, tags: DataFrame) -> DataFrame:
    """P10: question with its nested, sorted tag set ``array<struct<index,name>>``.  The nested
    list is bounded by the tags of one question."""
    t = qt.join(maybe_broadcast(tags), qt.tag == tags.name).select(
        "question_id", F.struct(F.col("tag_index").alias("index"), F.col("name")).alias("t"))
    nested = t.groupBy("question_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    return q.select("question_id", "title").join(nested, "question_id", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<struct<index:int,name:string>>")))


def to_questions(raw: DataFrame) -> DataFrame:
    """Clean source records: id, title, body, created and the tag names as a set."""
    return raw.select("question_id", "title", "body", "created_on",
                      F.array_sort(F.array_distinct("tags")).alias("tags"))


def assert_ids(df: DataFrame, col: str) -> DataFrame:
    """Rows whose id is missing, zero or not numeric."""
    v = F.col(col).cast("string").try_cast("bigint")
    return df.filter(v.isNull() | (v == 0))


# --- joins ------------------------------------------------------------------------------------

def unprocessed(q: DataFrame, log: DataFrame, learner: str, n: int | None = None, key: str = "question_id") -> DataFrame:
    """Questions without a metric row of ``learner``, by external id, first ``n``."""
    done = log.filter(F.col("learner") == learner).select(key)
    out = q.join(done, key, "left_anti")
    if n is not None:
        out = out.orderBy(key).limit(n)  # TakeOrderedAndProject: per-partition top-n, then merge
    return out


def question_tags(q: DataFrame, qt: DataFrame, tags: DataFrame) -> DataFrame:
    """Question × tag through the bridge."""
    return (q.select("question_id").join(qt, "question_id")
            .join(maybe_broadcast(tags), F.col("tag") == F.col("name"))
            .select("question_id", "tag_index", "name"))


def encode(df: DataFrame, vocab: DataFrame, col: str, name: str = "name", index: str = "index",
           out: str = "index") -> DataFrame:
    """Name → index through the vocabulary (inner join)."""
    v = vocab.select(F.col(name).alias("_name"), F.col(index).alias(out))
    return df.join(maybe_broadcast(v), F.col(col) == F.col("_name")).drop("_name")


def encode_unmatched(df: DataFrame, vocab: DataFrame, col: str, name: str = "name") -> DataFrame:
    """Rows whose name is not in the vocabulary (reported, not silently lost)."""
    v = vocab.select(F.col(name).alias("_name"))
    return df.join(maybe_broadcast(v), F.col(col) == F.col("_name"), "left_anti")


def stored_features(qtf: DataFrame, terms: DataFrame, key: str = "question_id") -> DataFrame:
    """(question, term, freq) × terms → sorted ``array<struct<index,freq>>`` per question."""
    enc = encode(qtf, terms, "term", name="name", index="term_index", out="index")
    return enc.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"),
                                             F.col("freq").cast("int").alias("freq")))).alias("features"))


def log_details(log: DataFrame, q: DataFrame, learners: DataFrame) -> DataFrame:
    """Metric log with its question and learner (FK joins)."""
    return (log.join(q.select("question_id", "title"), "question_id")
            .join(maybe_broadcast(learners.select(F.col("learner_id").alias("learner"), "parent_id", "is_active")),
                  "learner"))


def decode_predictions(pred: DataFrame, tags: DataFrame, key: str = "question_id") -> DataFrame:
    """Label indices → tag names.  ``general`` is returned sorted (a set); ``topk`` keeps the
    rank; an index with no tag leaves a null slot.  Lists are bounded by one prediction."""
    t = maybe_broadcast(tags.select(F.col("tag_index").alias("_i"), F.col("name")))

    def one(col: str) -> DataFrame:
        e = pred.select(key, F.posexplode_outer(col).alias("pos", "_i"))
        j = e.join(t, "_i", "left")
        return j.groupBy(key).agg(
            F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "name")))).alias("_s"))

    g = one("general").select(key, F.array_sort(F.transform("_s", lambda s: s["name"])).alias("general"))
    k = one("topk").select(key, F.transform("_s", lambda s: s["name"]).alias("topk"))
    return g.join(k, key)


def learner_tree(learners: DataFrame) -> DataFrame:
    """Every learner that a root reaches with its root and depth, by iterated parent joins (one
    join per level, until a level is empty).  ``unreached_learners`` returns the others."""
    edges = learners.select("learner_id", "parent_id")
    level = edges.filter(F.col("parent_id").isNull()).select(
        "learner_id", F.col("learner_id").alias("root_id"), F.lit(0).alias("depth"))
    out = level
    children = edges.filter(F.col("parent_id").isNotNull())
    for d in itertools.count(1):
        # each level is materialised in the shared checkpoint folder, so the emptiness test and
        # the next join start from stored rows instead of re-running every earlier level
        level = (children.join(level.select(F.col("learner_id").alias("parent_id"), "root_id"), "parent_id")
                 .select("learner_id", "root_id", F.lit(d).alias("depth"))).checkpoint(eager=True)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def unreached_learners(learners: DataFrame, tree: DataFrame) -> DataFrame:
    """Learners without a place in ``learner_tree``: members of a cycle, and those below a missing parent."""
    return learners.join(tree.select("learner_id"), "learner_id", "left_anti")


def fetch_or_store(vocab: DataFrame, names: DataFrame, name: str = "name", index: str = "index") -> DataFrame:
    """J8 (with W7, U4): known names keep their index; unknown ones are added once with the next
    indices in name order.  Returns the whole vocabulary."""
    new = names_minus(names.select(F.col(name).alias(name)), vocab, name)
    start = vocab.agg(F.coalesce(F.max(index) + 1, F.lit(0))).scalar()
    added = assign_index(new, name, start, out=index)
    return vocab.select(F.col(index).cast("int").alias(index), name).unionByName(
        added.select(F.col(index).cast("int").alias(index), name))


def label_results(results: DataFrame, configs: DataFrame, key: str = "learner", cfg_key: str = "learner_id") -> DataFrame:
    """Results × learner config by id; a missing config stays null (left join)."""
    c = configs.withColumnRenamed(cfg_key, "_cfg_key")
    return results.join(maybe_broadcast(c), F.col(key) == F.col("_cfg_key"), "left").drop("_cfg_key")


def tag_pairs(qt: DataFrame, chosen: DataFrame, key: str = "question_id", tag: str = "tag") -> DataFrame:
    """(question, tag1 < tag2) pairs among a chosen tag set of any size (semi join before the
    self join, so a question's pairs are bounded by its own chosen tags)."""
    c = maybe_broadcast(chosen.select(F.col(tag).alias("_t")))
    q = qt.join(c, F.col(tag) == F.col("_t"), "left_semi").select(key, tag)
    a, b = q.alias("a"), q.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{tag}") < F.col(f"b.{tag}"))).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{tag}").alias("tag1"), F.col(f"b.{tag}").alias("tag2"))


def param_grid(spark, **options: Sequence) -> DataFrame:
    """Every combination of the option lists, built by one ``explode`` per option (no join)."""
    df = spark.range(1).select()
    for name, values in options.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid_minus(grid: DataFrame, ignored: DataFrame, cols: Sequence[str], sep: str = " - ",
               ignored_col: str = "config") -> DataFrame:
    """Grid rows whose ``concat_ws(sep, cols)`` key is on the ignore list."""
    g = grid.withColumn("_key", F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))
    return g.join(maybe_broadcast(ignored.select(F.col(ignored_col).alias("_key"))), "_key", "left_anti").drop("_key")


# --- set operations ---------------------------------------------------------------------------

def all_features(new: DataFrame, stored: DataFrame) -> DataFrame:
    """U1."""
    return new.unionByName(stored)


def concat_categories(*dfs: DataFrame) -> DataFrame:
    """U2."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def predicted_labels(pos, topk) -> Column:
    """Positive ∪ top-k label set."""
    p = F.col(pos) if isinstance(pos, str) else pos
    k = F.col(topk) if isinstance(topk, str) else topk
    return F.array_sort(F.array_union(p, k))


def names_minus(names: DataFrame, vocab: DataFrame, name: str = "name") -> DataFrame:
    """U4: distinct names not in the vocabulary."""
    return names.select(name).distinct().join(vocab.select(name), name, "left_anti")


def domain_equal(df: DataFrame, col: str, domain: Iterable[str]) -> DataFrame:
    """One row: values outside the domain, domain values never seen, and equality.  Works on
    the distinct values (an aggregate), never on a collected column."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(str(v),) for v in domain], "v string")
    seen = df.select(F.col(col).cast("string").alias("v")).distinct()
    extra = seen.join(F.broadcast(dom), "v", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    missing = dom.join(seen, "v", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.range(1).select(
        F.lit(col).alias("column"), extra.alias("n_extra"), missing.alias("n_missing"),
        ((extra == 0) & (missing == 0)).alias("is_equal"))


def edge_nodes(edges: DataFrame, a: str = "tag1", b: str = "tag2") -> DataFrame:
    """Distinct nodes of an edge list."""
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()


# --- table writes (batch forms) ---------------------------------------------------------------

def append_rows(base: DataFrame, new: DataFrame, batch_ts, ts: str = "created_on") -> DataFrame:
    """K1: append, filling a missing creation time with the batch time."""
    t = batch_ts if isinstance(batch_ts, Column) else F.lit(batch_ts)
    return base.unionByName(new.withColumn(ts, F.coalesce(F.col(ts), t)))


def upsert(base: DataFrame, delta: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """K2: union and keep, per key, the row of the highest version (last write wins; a null version
    is the lowest, and equal versions are settled by the remaining columns).  ``max`` is a partial
    aggregate, so a hot key is reduced map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    u = base.unionByName(delta)
    others = [c for c in u.columns if c not in keys]
    first = [version, *[c for c in others if c != version]]
    pick = F.max(F.struct(*first)).alias("_row")
    return u.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K3."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def deactivate(learners: DataFrame, discarded: DataFrame, key: str = "learner_id") -> DataFrame:
    """K4: discarded learners get ``is_active = 0``."""
    d = discarded.select(F.col(key).alias("_d")).distinct().withColumn("_hit", F.lit(1))
    j = learners.join(maybe_broadcast(d), F.col(key) == F.col("_d"), "left")
    return j.withColumn("is_active", F.when(F.col("_hit").isNotNull(), F.lit(0)).otherwise(F.col("is_active"))
                        .cast("int")).drop("_d", "_hit")
