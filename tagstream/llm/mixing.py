"""Operator 3, mixing sources to target weights: hierarchical budgeting.

Documents hang at the leaves of a tree (domain, language, source).  A node can give at most its
tokens times ``max_epochs``.  The budget flows from the root: at each node it is shared among the
children in proportion to their weights, a child that cannot take its share is filled, and what it
leaves goes to its siblings (water filling).  As a child's limit is what its whole subtree holds, a
shortage is met among siblings first and reaches an ancestor's siblings only when the subtree is dry.

A leaf's quota is drawn from seeded epochs: whole epochs of the leaf first, then the longest prefix,
in the seeded order of the next epoch, whose tokens fit.  The order is a hash, so a leaf is cut into
hash buckets of about ``BUCKET_ROWS`` rows; bucket totals tell in which bucket the prefix ends, and
only that bucket is sorted.  Texts are not shuffled, save those of the buckets that are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored, text_of, words_of

#: Rows of a leaf that share a hash bucket, on average.
BUCKET_ROWS = 10_000
#: A leaf table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_LEAVES = 100_000
_HEX = 13  # hex digits of a position: 52 bits, exact as a double and in other engines


def position(seed: int, epoch: Column, id_: Column) -> Column:
    """Place of a document in an epoch's order, from 0 up to 16 ** 13."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("long")


def water_fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``alloc``: each parent's ``budget`` shared by weight ``w`` up to ``cap``."""
    ratio = F.col("cap") / F.col("w")
    order = Window.partitionBy(*parent).orderBy("ratio", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = (children.filter("w > 0").withColumn("ratio", ratio)
          .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
          .withColumn("top", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(Window.partitionBy(*parent))))
    share = F.least(F.col("cap").cast("double"), F.col("top") * F.col("w"))
    return df.withColumn("alloc", F.when(F.col("top").isNull(), F.col("cap").cast("double")).otherwise(F.greatest(share, F.lit(0.0)))).drop("ratio", "level", "top")


def quotas(leaves: DataFrame, levels: list[str], weights: dict[tuple, float], budget: int, max_epochs: int) -> DataFrame:
    """Leaf rows (levels, tokens, docs) with ``quota`` tokens.  ``weights``: path of names -> weight, 1 if absent."""
    spark = leaves.sparkSession
    spec = spark.createDataFrame([("\x1f".join(map(str, k)), float(v)) for k, v in weights.items()] or [("\x1f\x1f", 1.0)], "path string, given double")
    above: DataFrame | None = None
    for d, name in enumerate(levels):
        path = levels[:d + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("path", F.concat_ws("\x1f", *path)).join(F.broadcast(spec), "path", "left")
        nodes = nodes.withColumn("w", F.coalesce("given", F.lit(1.0))).withColumn("name", F.col(name)).drop("path", "given")
        if above is None:
            nodes, parent = nodes.withColumn("budget", F.lit(float(budget))).withColumn("root", F.lit(0)), ["root"]
        else:
            nodes, parent = nodes.join(above, levels[:d]), levels[:d]
        above = water_fill(nodes, parent).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(above, levels).withColumn("quota", F.floor("budget").cast("long")).drop("budget")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float], budget_share: float, max_epochs: int = 1,
        seed: int = 7, id_col: str = "doc_id", text_col: str = "text", token_col: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs``, once per epoch in which they are chosen, with ``mix_epoch``, ``mix_tokens``
    and a column ``mix_<level>`` for each level.

    ``levels``: level name -> column, root first.  A null name counts as the empty name.  The budget
    is ``budget_share`` of all tokens.  Tokens are words unless ``token_col`` says otherwise; a text
    without tokens is taken with its whole epochs or its prefix.  Equal places in the order (repeated
    ids) are taken together or not at all.  A null id has a place like any other.  The new columns
    replace input columns of their names.
    """
    prepare(docs.sparkSession)
    names = [f"mix_{k}" for k in levels]
    tokens = F.size(words_of(text_of(text_col))) if token_col is None else token_col
    own = [c for c in docs.columns if c not in (*names, "mix_tokens", "mix_epoch")]
    rows = docs.select(F.struct(*own).alias("mix_row"), F.col(id_col).alias("mix_id"),
                       *[F.coalesce(c.cast("string"), F.lit("")).alias(f"mix_{k}") for k, c in levels.items()], tokens.cast("long").alias("mix_tokens"))
    leaves = stored(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "op3-leaves")
    whole = leaves.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    budget = int((whole["t"] or 0) * budget_share)
    plan = quotas(leaves, names, weights, budget, max_epochs)
    per = F.greatest(F.col("tokens"), F.lit(1))
    plan = plan.select(*names, F.floor(F.col("quota") / per).cast("long").alias("mix_full"), (F.col("quota") % per).alias("mix_rest"),
                       F.ceil(F.col("docs") / BUCKET_ROWS).cast("long").alias("mix_buckets"))
    plan = stored(plan, "op3-plan")
    small = (lambda d: F.broadcast(d)) if whole["n"] <= BROADCAST_LEAVES else (lambda d: d)

    placed = rows.join(small(plan), names).withColumn("mix_place", position(seed, F.col("mix_full"), F.col("mix_id")))
    placed = placed.withColumn("mix_bucket", F.floor(F.col("mix_place") / F.lit(float(16 ** _HEX)) * F.col("mix_buckets")).cast("long"))
    totals = placed.groupBy(*names, "mix_bucket").agg(F.sum("mix_tokens").alias("t"), F.first("mix_rest").alias("mix_rest"))
    run = Window.partitionBy(*names).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("upto", F.sum("t").over(run)).filter(F.col("upto") > F.col("mix_rest"))
    cut = totals.groupBy(*names).agg(F.min("mix_bucket").alias("mix_cut"), F.min(F.col("upto") - F.col("t")).alias("mix_before"))
    cut = stored(cut, "op3-cut")
    # a leaf that is used up in all its epochs has no prefix to take: its rest is 0, and its cut the first bucket with tokens
    placed = placed.join(small(cut), names, "left")
    out = [*[F.col("mix_row")[c].alias(c) for c in own], *names, "mix_tokens", "mix_epoch"]
    whole_epochs = placed.filter("mix_full > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), (F.col("mix_full") - 1).cast("int")))).select(*out)
    part = placed.filter((F.col("mix_full") < max_epochs) & (F.col("mix_rest") > 0)).withColumn("mix_epoch", F.col("mix_full").cast("int"))
    before = part.filter(F.col("mix_cut").isNull() | (F.col("mix_bucket") < F.col("mix_cut"))).select(*out)
    inside = Window.partitionBy(*names).orderBy("mix_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    split = (part.filter(F.col("mix_bucket") == F.col("mix_cut"))
             .withColumn("mix_upto", F.col("mix_before") + F.sum("mix_tokens").over(inside))
             .filter(F.col("mix_upto") <= F.col("mix_rest")).select(*out))
    return whole_epochs.unionByName(before).unionByName(split)
