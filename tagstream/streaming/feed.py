"""T1, the ordered feed: a stream whose offsets are chunks and rows of the data.

A feed is a table of rows numbered in their order and laid out by chunk; one job writes all chunks.
The stream source yields the ranges ``(chunk_no, from_row, to_row)`` that come next, so the order rests
on row numbers alone: neither names nor times of files matter.  The ranges are joined with the table,
whose partition column is the chunk, so a micro-batch reads its own chunks only.  A restarted query goes
on at the chunk after the last committed one; ``start_row`` begins at a count already trained.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tagstream.operators.windows import chunk_no
from tagstream.streaming.commits import CommitLog

FORMAT = "tagstream_feed"


def write_feed(df: DataFrame, path: str, batch_size: int, order_col: str = "question_id") -> None:
    """Append ``df`` to the feed at ``path``: chunks of ``batch_size`` rows in the order of ``order_col``.

    Appended rows come after those already there and start a new chunk; a query that starts later reads
    them.  Two columns are added: chunk_no, and row_no, the position in the whole feed."""
    log = CommitLog(df.sparkSession, path)
    done = [log.read(n) for n in log.numbers()]
    chunk = max((r["chunk"] + r["chunks"] for r in done), default=0)
    row = sum(r["rows"] for r in done)
    numbered = chunk_no(df, order_col, batch_size)
    numbered = numbered.withColumn("row_no", (F.col("rn") - 1 + row).cast("long")).withColumn("chunk_no", (F.col("chunk_no") + chunk).cast("long")).drop("rn")
    numbered.repartitionByRange("row_no").sortWithinPartitions("row_no").write.mode("append").partitionBy("chunk_no").parquet(path)
    mine = df.sparkSession.read.parquet(path).filter(F.col("chunk_no") >= chunk)
    rows = mine.count()
    log.publish(len(done), {"chunk": chunk, "chunks": -(-rows // batch_size), "row": row, "rows": rows, "size": batch_size})


class FeedSource(DataSource):
    """Options: parts (JSON list of appended parts), chunks (a micro-batch), start_row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "chunk_no long, from_row long, to_row long"

    def simpleStreamReader(self, schema):
        return FeedReader(json.loads(self.options["parts"]), int(self.options["chunks"]), int(self.options["start_row"]))


class FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, parts: list[dict], chunks: int, start_row: int):
        self.parts, self.chunks, self.start_row = parts, chunks, start_row

    def _range(self, chunk: int) -> tuple[int, int, int] | None:
        for p in self.parts:
            if p["chunk"] <= chunk < p["chunk"] + p["chunks"]:
                first = p["row"] + (chunk - p["chunk"]) * p["size"]
                return chunk, max(first, self.start_row), min(first + p["size"], p["row"] + p["rows"])
        return None

    def initialOffset(self) -> dict:
        chunk = 0
        while (r := self._range(chunk)) and r[2] <= self.start_row:
            chunk += 1
        return {"chunk": chunk, "row": self.start_row}

    def read(self, start: dict):
        found = [r for c in range(start["chunk"], start["chunk"] + self.chunks) if (r := self._range(c))]
        end = {"chunk": found[-1][0] + 1, "row": found[-1][2]} if found else start
        return iter(found), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for c in range(start["chunk"], end["chunk"]) if (r := self._range(c))])

    def commit(self, end: dict) -> None:
        pass


def _ranges(spark: SparkSession, path: str, chunks: int, start_row: int) -> DataFrame:
    spark.dataSource.register(FeedSource)
    log = CommitLog(spark, path)
    parts = [log.read(n) for n in log.numbers()]
    return (spark.readStream.format(FORMAT).option("parts", json.dumps(parts)).option("chunks", chunks)
            .option("start_row", start_row).load())


def feed(spark: SparkSession, path: str, schema=None, chunks_per_trigger: int = 1, start_row: int = 0) -> DataFrame:
    """T1 as a streaming DataFrame, ``chunks_per_trigger`` chunks a micro-batch, for operators that keep
    their own state.  Spark prunes no partitions by a streaming side, so each micro-batch scans the chunk
    column's folders; ``each_batch`` reads its own chunks only.

    Run it with ``drained`` to the end of the feed, or with a processing-time trigger; an available-now
    trigger takes one micro-batch a run, since sources of this kind tell Spark one offset at its start."""
    rows = spark.read.parquet(path)
    out = rows.join(F.broadcast(_ranges(spark, path, chunks_per_trigger, start_row)), "chunk_no")  # at most chunks_per_trigger ranges
    out = out.filter((F.col("row_no") >= F.col("from_row")) & (F.col("row_no") < F.col("to_row")))
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return out.select(*(schema.names if schema is not None else rows.columns))


def each_batch(spark: SparkSession, path: str, step: Callable[[DataFrame, int], None], checkpoint: str,
               chunks_per_trigger: int = 1, start_row: int = 0):
    """Starts ``step(rows, batch number)`` over the micro-batches of the feed; each reads the folders of its
    own chunks.  Run it to the end of the feed with ``drained``."""
    rows = spark.read.parquet(path)

    def run(ranges: DataFrame, n: int) -> None:
        found = [tuple(r) for r in ranges.collect()]  # chunks_per_trigger ranges
        if found:
            mine = rows.filter(F.col("chunk_no").isin([c for c, _, _ in found]))
            low, high = min(a for _, a, _ in found), max(b for _, _, b in found)
            step(mine.filter((F.col("row_no") >= low) & (F.col("row_no") < high)), n)

    stream = _ranges(spark, path, chunks_per_trigger, start_row)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def drained(query) -> None:
    """Runs a started query until the feed has no further chunk."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
