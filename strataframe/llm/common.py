"""Shared pieces of the text operators: table access, shared-folder tables, Arrow text views.

Every helper here works on one bounded Arrow slice at a time, so a task's memory does not
depend on the size of its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written as materialize

__all__ = ["Words", "crc32_of", "joined_by_hubs", "lowered", "mapped", "materialize", "mixed", "slices", "table", "word_hashes"]

#: Text bytes that a task looks at together.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once, at most; Spark's own bound is eight times that.
BATCH_BYTES = 8 << 20

#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with fewer partitions than cores (a small file of one row group) is dealt out
    over the cores. Larger tables are read where they lie, without an exchange."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow() over batches of BATCH_BYTES at most: long texts come a few at a time.
    The bound is a setting of the session, lowered here if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = re.fullmatch(r"(-?\d+)b?", conf.get(name, f"{1 << 30}b"))
    if now is None or int(now[1]) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


#: Keys that may have more than the so-manieth part of all rows; no more than so many can.
HUBS = 500


def joined_by_hubs(rows: DataFrame, told: DataFrame, key: str, often: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows join told on key. told has one row for each key, with how often rows has it (dropped). Rows of the few keys that have more
    than n_rows / HUBS of them stay where they lie and meet a broadcast of HUBS rows at most; the others are shuffled."""
    many = F.col(often) * HUBS > n_rows
    hubs, others = told.filter(many).drop(often), told.filter(~many).drop(often)
    of_hubs = rows.join(F.broadcast(hubs), key)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key, how)
    return of_hubs.unionByName(rest)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch with about limit text bytes each (one row at least), each with
    its UTF-8 bytes and row offsets. A null text counts as empty."""
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


class Words:
    """The words of some texts: runs of bytes that part[] does not name.

    data holds the words' bytes without what parts them, offsets the words in it, first the
    words of each text, starts and ends the words' places in the texts' bytes.
    """

    def __init__(self, data: np.ndarray, rows: np.ndarray, part: np.ndarray = SPACE):
        inside = ~part[data]
        n = len(data)
        edge = np.ones(n + 1, bool)
        edge[1:n] = ~inside[:-1]
        edge[rows[:-1]] = True
        begin = inside & edge[:n]
        last = np.ones(n, bool)
        last[:-1] = ~inside[1:] if n else False
        last[rows[1:][rows[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(inside & last) + 1
        self.data = data[inside]
        self.offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=self.offsets[1:])
        self.first = np.searchsorted(self.starts, rows)
        self.n = np.diff(self.first)

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words and each word's index in them."""
        if not len(self.starts):
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads them (the splitmix64 finisher)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of the words by their bytes: each distinct word is hashed once."""
    import xxhash

    distinct, index = words.coded()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return table[index] if len(index) else np.zeros(0, np.uint64)


def crc32_of(column: str):
    """crc32 of a column's text form."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
