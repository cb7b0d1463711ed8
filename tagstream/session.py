"""Session construction and small plan helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound (bytes) for a side we are willing to broadcast explicitly.  Above it the
# helpers fall back to a shuffle join and let AQE decide at runtime.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tagstream",
              driver_memory: str = "16g") -> SparkSession:
    """Local/test session.  On a cluster the existing session is reused unchanged (its driver and
    executor memory come from the submitter)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode runs every executor thread inside the driver JVM
            b = b.config("spark.driver.memory", driver_memory)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Settings every job relies on: UTC time and a shared checkpoint folder.

    The checkpoint folder is read from ``spark.checkpoint.dir``; only when the cluster names none
    (local tests) do we set one of our own.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # per-key state processors (transformWithState) keep several column families per key
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # a side already hash-clustered by a subset of the join keys (e.g. a table bucketed by
    # question joined on (question, node)) is used as is instead of being shuffled again
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    checkpoint_dir(spark)
    ship_package(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Only a one-machine ``local[...]`` master, as in tests, gets a folder of its own when the
    setting is absent; on a cluster that is an error, since executors share no local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join(tempfile.gettempdir(), "tagstream-checkpoints")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever it was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tagstream-ship-"), "tagstream.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tagstream", os.path.relpath(full, here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location, for written intermediate tables."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables that this application has written so far; returns how many folders.

    For the caller to run once the results that read them are written or collected."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, name: str) -> DataFrame:
    """A small derived table, written.

    The optimizer's estimate of a derived table follows its inputs, however few rows come out; that
    of a written one follows its files, so ``maybe_broadcast`` then decides by the measured size.
    """
    return written(df, name)


#: Bytes of text that a task gets where texts become words; their rows take a multiple of that in memory.
TEXT_BYTES = 8 * 1024 * 1024


def text_partitions(df: DataFrame, column: str, limit: int | None = None) -> int:
    """Partitions that leave at most about ``limit`` bytes of the texts in ``column`` to each, and no fewer than
    the session's.  The texts are measured (one scan): their size in files says little."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (TEXT_BYTES if limit is None else limit)))


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - plan access differs on Connect
        return None


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when the optimizer proves it is below ``limit`` bytes.

    Otherwise the plain DataFrame is returned and the join shuffles (AQE may still turn it into a
    broadcast join at runtime once the real size is known).
    """
    n = estimated_bytes(df)
    if n is not None and n <= limit:
        return F.broadcast(df)
    return df


def units_to_f(c: Column | str, scale: int = 50000) -> Column:
    """Fixed-point F units to a double (the fixture keeps F in 1/50000 units)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double") / F.lit(float(scale))


def write_bucketed(df: DataFrame, name: str, n_buckets: int, key: str | list[str],
                   sort_cols: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a bucketed Parquet table in the shared checkpoint folder and read it back.

    The scan then reports hash partitioning on ``key``: later joins, windows and aggregates keyed
    by ``key`` (or a superset) run without an exchange, and the written table cuts the lineage.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    path = scratch_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    w = df.write.mode("overwrite").option("path", path).bucketBy(n_buckets, *keys)
    if sort_cols:
        w = w.sortBy(*sort_cols)
    w.saveAsTable(table)
    return spark.table(table)
