"""A commit log for state that advances batch by batch (T4, T5, M17) and for the feed's chunks.

A step writes its tables to folders of its own and then publishes one record that names them, under
the number of its batch.  Publishing is one rename that fails if the record exists, so a batch has
either all of its tables or none, and a replayed batch finds its record and does nothing.  Folders of
a step that failed are named by no record and are never read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))

    def _file(self, n: int):
        return self._path(self.root, "_commits", f"{n:012d}.json")

    def folder(self, name: str, n: int) -> str:
        """A fresh folder for a table of batch ``n``."""
        return os.path.join(self.root, name, f"{n:012d}-{uuid.uuid4().hex[:8]}")

    def read(self, n: int) -> dict | None:
        """The record of batch ``n``."""
        file = self._file(n)
        if n < 0 or not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """Published batches, in order (one small file each)."""
        folder = self._path(self.root, "_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def publish(self, n: int, record: dict) -> bool:
        """True if this call published batch ``n``; False if a record was there already."""
        draft = self._path(self.root, "_commits", f"_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._file(n)), plain)
            return True
        except Exception:
            if self.read(n) is None:
                raise
            self._fs.delete(draft, False)
            return False

    def table(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """Rows of the table ``name`` of all published batches (below ``upto``), with their ``batch``."""
        out = self.spark.createDataFrame([], f"{schema}, batch long")
        for n in self.numbers():
            record = self.read(n) if upto is None or n < upto else None
            if record and name in record:
                out = out.union(self.spark.read.schema(schema).parquet(record[name]).withColumn("batch", F.lit(n).cast("long")))
        return out
