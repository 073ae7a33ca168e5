"""Functions in Python, Arrow batches at a time, for what the built-in ones can't express."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@F.pandas_udf(T.DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@F.udf(T.StringType(), useArrow=True)
def flags(returned: str, status: str) -> str:
    return f"{returned}/{status}".lower()


@F.pandas_udf(T.DoubleType())
def log_sum(x: pd.Series) -> float:
    return float(np.log(x.dropna()).sum())


@F.pandas_udf(T.LongType())
def known(x: pd.Series) -> int:
    return int(x.notna().sum())


def demeaned(frame: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: lines of some orders with their distance from their order's mean price."""
    mean = frame.groupby("l_orderkey")["l_extendedprice"].transform("mean")
    return frame.assign(distance=frame["l_extendedprice"] - mean).drop(columns="l_extendedprice")


def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For cogroup: how many rows both sides have of each key."""
    n = pd.DataFrame({"orders": left["o_orderkey"].value_counts(), "lines": right["l_orderkey"].value_counts()}).fillna(0).astype("int64")
    return n.rename_axis("order_key").reset_index()


def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: event_id and twice the value."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("event_id"), pc.multiply(b.column("value"), 2.0)], names=["event_id", "twice"])


@F.udtf(returnType=T.StructType().add("word", "string").add("place", "integer"))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str):
        for k, w in enumerate((text or "").split(" ")):
            if w:
                yield w, k


@F.udtf
class Sessions:
    """Runs of rows of a partition that are less than some minutes apart; the rows come in the order of their times.
    The result's columns are named and typed after the table's."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows is a table")
        columns = {f.name: f.dataType for f in rows.dataType}
        if missing := {key.value, at.value} - columns.keys():
            raise ValueError(f"the table has no column {', '.join(sorted(map(str, missing)))}")
        time = columns[at.value]
        return AnalyzeResult(T.StructType().add(key.value, columns[key.value]).add("session_start", time).add("session_end", time).add("n", T.LongType()))

    def __init__(self):
        self.open = None

    def _told(self):
        key, start, last, n, gap = self.open
        return key, start, last + gap, n

    def eval(self, rows: T.Row, key: str, at: str, minutes: int):
        gap, time = datetime.timedelta(minutes=minutes), rows[at]
        if time is None:
            return
        if self.open and time - self.open[2] < gap:
            self.open = (self.open[0], self.open[1], time, self.open[3] + 1, gap)
            return
        if self.open:
            yield self._told()
        self.open = (rows[key], time, time, 1, gap)

    def terminate(self):
        if self.open:
            yield self._told()
