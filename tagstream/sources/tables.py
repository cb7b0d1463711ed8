"""Driver tables as lazily read Parquet DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# Tables whose rows carry long texts: per-row work on them is CPU-bound (regex, tokenising).
TEXT_TABLES = ("documents", "pages", "conversations")


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than the cluster has cores (e.g. one Parquet
    row group).  A large input already scans in many splits and is returned unchanged, so no
    shuffle is added at scale."""
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover
        return df
    return df.repartition(cores) if n < cores else df


class Tables:
    """``Tables(spark, "/data/sf0.1").documents`` reads ``documents.parquet`` once per instance.

    Reads are plain ``spark.read.parquet`` so column pruning and filter push-down reach the scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        p = os.path.join(self.root, f"{name}.parquet")
        return p

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self.spark.read.parquet(self.path(name))
            if name in TEXT_TABLES:
                df = spread_if_narrow(df)
            self._cache[name] = df
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)
