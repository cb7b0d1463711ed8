"""Helpers that the training-data operators share.

Conventions of every operator in this package
---------------------------------------------
* It selects the id and text columns it needs and names its own columns; further input columns,
  whatever their names, are ignored (pipeline stages hand them through untouched).
* A null text is an empty text.  A row whose id is null is kept as a row of its own: it is never
  matched with other rows by id and belongs to no training fold.
* Repeated rows give repeated result rows; an empty table gives an empty result.
* Intermediate tables go to the shared folder of ``spark.checkpoint.dir`` as Parquet, so a lost
  executor costs only the tasks it ran.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.session import prepare_session, scratch_path

#: Rows of one Arrow batch: texts are long, so a batch of this many stays a few megabytes.
BATCH_ROWS = 1000

#: A word is a run of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def fold(id_col: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one aggregate, used to choose partition counts that follow the input."""
    return df.select(F.sum(F.octet_length(text_of(text_col))).alias("b")).first()["b"] or 0


def parts_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    return max(1, -(-n_bytes // per_part))
