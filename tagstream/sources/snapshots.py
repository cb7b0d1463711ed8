"""Model snapshots (S13): versioned Parquet rows, newest ``n`` kept per learner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.operators.windows import newest_n


def snapshot(df: DataFrame, path: str, learner: str = "learner", version_ts: str = "created_on") -> None:
    """Append a new version of each learner's state (partitioned by learner)."""
    df.write.mode("append").partitionBy(learner).parquet(path)


def retain_latest(snaps: DataFrame, key: str, ts: str, n: int = 20, discarded: DataFrame | None = None,
                  tiebreak: str | None = None) -> DataFrame:
    """The newest ``n`` versions per key; every version of a discarded key is removed."""
    d = snaps
    if discarded is not None:
        d = d.join(discarded.select(key).distinct(), key, "left_anti")
    return newest_n(d, key, ts, n, tiebreak=tiebreak)
