"""Sorts and limits (O1, O2).  ``orderBy().limit(n)`` is planned as TakeOrderedAndProject (top-n
per partition, then a merge of n rows per partition); a full ``orderBy`` is a range-partitioned
sort."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """O1: the first ``n`` rows by ``key``."""
    return df.orderBy(key).limit(n)


def oldest_first(df: DataFrame, ts: str = "created_on", key: str = "question_id") -> DataFrame:
    """O2."""
    return df.orderBy(ts, key)
