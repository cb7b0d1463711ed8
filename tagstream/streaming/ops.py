"""Operators shared by the streaming jobs and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, key: str, ts: str) -> DataFrame:
    """T7 batch form: the first arrival per external id.  (Stream form:
    ``withWatermark(ts).dropDuplicatesWithinWatermark([key])``.)  ``min_by`` is a partial
    aggregate, so repeated ids collapse map-side."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(ts, *[c for c in others if c != ts])).alias("_r")) \
        .select(key, "_r.*")


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Arrivals per 1-day tumbling window (UTC)."""
    w = F.window(F.col(ts).cast("timestamp"), "1 day")
    return df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("day_start"),
        F.col("w.end").cast("timestamp_ntz").alias("day_end"), "n")


def drop_custom(df: DataFrame, flag: str = "is_custom") -> DataFrame:
    """Ad-hoc instances are scored and trained but never logged."""
    return df.filter(F.col(flag) == 0)
