"""Operator 7, exact dedup: grouping by a 128-bit content hash, with the bytes compared.

Rows are grouped by the hash *and* the text itself, so two texts that share a hash stay apart: the
grouping compares their bytes.  The sums are partial first, so any number of copies is one row per
task.  Each document then finds its group by hash and SHA-256, small rows whose hot groups adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored, text_of


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest (``min``) or largest (``max``) id of a group stays.  Null texts are
    empty texts.  A null id stays only in a group without any other id.  Repeated rows of the id that
    stays all stay (they are one document), and each counts in group_size.
    """
    prepare(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(F.lit("second"), text).alias("h2"), F.sha2(text, 256).alias("text_sha256"))
    best = F.min("id") if keep == "min" else F.max("id")
    groups = rows.groupBy("h1", "h2", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.select("h1", "h2", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "op7-groups")
    out = rows.drop("text").join(groups, ["h1", "h2", "text_sha256"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
