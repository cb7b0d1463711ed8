"""Per-key state processors: online thresholds (X3) and running F totals.

They keep a key's state in ``transformWithStateInPandas`` value states and hold the rows of one key and
one micro-batch, which the ordered feed bounds by its chunks.  ``carried.py`` has the forms of T4 and T5
that also split a key's rows over tasks; the batch replay (M14) is in ``operators/thresholds.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tagstream.operators.thresholds import A0, B0, OUT, thresholds
from tagstream.operators.thresholds import steps as threshold_steps

THRESHOLD_A0, THRESHOLD_B0 = float(A0), float(B0)
THRESHOLD_OUT = OUT


def online_thresholds(scored: DataFrame, bits: int | None = None) -> DataFrame:
    """M14 (batch replay): per label, in question order, the threshold in force before each row and the
    resulting decision, replayed by blocks.  ``scored``: (tag_index, question_id, score, y)."""
    return thresholds(scored, bits=bits)


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch in question order, whatever Arrow batches they come in.

    What is held is bounded by the trigger (``files_per_trigger`` files of the feed's batch size)."""
    parts = list(rows)
    if parts:
        yield pd.concat(parts, ignore_index=True).sort_values("question_id", kind="stable", ignore_index=True)


class ThresholdProcessor(StatefulProcessor):
    """Online threshold state per label for a stream of scored rows.  Micro-batches
    arrive in question order (T1); rows inside a batch are sorted by question."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ab = handle.getValueState("ab", StructType([StructField("a", DoubleType()), StructField("b", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        a, b = (self.ab.get() if self.ab.exists() else (THRESHOLD_A0, THRESHOLD_B0))
        for pdf in _in_order(rows):
            thr, yh, a, b = threshold_steps(pdf["score"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), a, b)
            yield pd.DataFrame({"tag_index": pdf["tag_index"].astype("int32"), "question_id": pdf["question_id"].astype("int64"),
                                "score": pdf["score"].astype(float), "y": pdf["y"].astype("int32"),
                                "threshold": thr, "y_hat": yh})
        self.ab.update((float(a), float(b)))

    def close(self) -> None:
        pass


RUNNING_OUT = "learner string, category string, question_id long, units long, total long, n long"


class RunningTotalProcessor(StatefulProcessor):
    """Running cumulative F (integer units) and count per (learner, category)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", StructType([StructField("total", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n = (self.acc.get() if self.acc.exists() else (0, 0))
        for pdf in _in_order(rows):
            units = pdf["units"].astype("int64").to_numpy()
            run = total + np.cumsum(units)
            cnt = n + np.arange(1, len(units) + 1)
            if len(units):
                total, n = int(run[-1]), int(cnt[-1])
            yield pd.DataFrame({"learner": pdf["learner"], "category": pdf["category"],
                                "question_id": pdf["question_id"].astype("int64"), "units": units,
                                "total": run.astype("int64"), "n": cnt.astype("int64")})
        self.acc.update((int(total), int(n)))

    def close(self) -> None:
        pass


def running_total(events: DataFrame) -> DataFrame:
    """T4: ``events`` (learner, category, question_id, units) → running totals per key."""
    return (events.select("learner", "category", F.col("question_id").cast("long"), F.col("units").cast("long"))
            .groupBy("learner", "category")
            .transformWithStateInPandas(RunningTotalProcessor(), RUNNING_OUT, "append", "None"))


def threshold_stream(scored: DataFrame) -> DataFrame:
    """T5: online thresholds over a stream of (tag_index, question_id, score, y)."""
    return (scored.select(F.col("tag_index").cast("int"), F.col("question_id").cast("long"),
                          F.col("score").cast("double"), F.col("y").cast("int"))
            .groupBy("tag_index")
            .transformWithStateInPandas(ThresholdProcessor(), THRESHOLD_OUT, "append", "None"))
