"""Incremental and paged loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.operators.aggregates import EPOCH
from tagstream.operators.windows import prefix_aggregate


def load_since(src: DataFrame, sink: DataFrame, ts: str, end: str, sink_ts: str | None = None) -> DataFrame:
    """Rows of ``src`` with ``max(sink.ts) + 1 s <= ts < end``.  The high-water mark is a
    scalar subquery (one aggregate job, the value inlined into the scan filter)."""
    mark = sink.agg(F.coalesce(F.max(sink_ts or ts), F.lit(EPOCH).cast("timestamp_ntz"))).scalar()
    start = mark + F.expr("INTERVAL 1 SECOND")
    return src.filter((F.col(ts) >= start) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def next_page(df: DataFrame, offset: int, size: int, ts: str = "created_on", key: str = "question_id") -> DataFrame:
    """S3: skip ``offset`` rows (oldest first, ties by key) and take the next ``size``.

    Positions come from a bucketed running count rather than a global ``offset`` (which would
    pull every preceding row through one task)."""
    d = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    d = prefix_aggregate(d, [], ["_t", key], "_t", sums={"_rn": F.lit(1)})
    return d.filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + size)).drop("_t", "_rn")


def read_through(local: DataFrame, remote: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for ``keys`` from the local store, else from the remote source (and tagged so the
    caller can append them locally)."""
    k = keys.select(key).distinct()
    have = local.join(k, key, "left_semi").withColumn("origin", F.lit("local"))
    fetched = remote.join(k, key, "left_semi").join(local.select(key), key, "left_anti").withColumn(
        "origin", F.lit("remote"))
    return have.unionByName(fetched)
