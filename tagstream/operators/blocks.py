"""Rows in order, cut into blocks of bounded size: what running totals and replays of hot keys work on.

One range sort puts all rows in the order of (keys, order columns) and is written; ``at`` is a row's place
in it.  A block is the rows of one key among 2 ** bits places, so no block has more rows than that, and a
key that holds a third of all rows has many blocks.  Per-block totals are small; carrying them on from
block to block needs one row per key and block.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagstream.session import scratch_path

#: Rows of a block as a power of two.
BLOCK_BITS = 16


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, bits: int | None = None) -> DataFrame:
    """``df`` stored in the order of ``keys`` and ``order``, with ``at`` (place) and ``block``."""
    bits = BLOCK_BITS if bits is None else bits
    spark = df.sparkSession
    path = os.path.join(scratch_path(spark, name), "rows")
    cols = [*keys, *order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    return spark.read.parquet(path).withColumn("block", F.shiftright("at", bits))


def carried(totals: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Of per-(key, block) totals: the sums over the earlier blocks of the key, under the same names."""
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])
