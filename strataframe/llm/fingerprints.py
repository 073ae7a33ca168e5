"""Document fingerprints by MinHash, and how like each document is to its edited text and to the next one.

A fingerprint is MINIMA minima of universal hashes a*x+b over a text's distinct shingles of five words, 16
bits of each, in hexadecimal; the share of equal minima of two fingerprints estimates the Jaccard similarity of
their sets. What the estimate says is verified in place: both sets lie in the task, so the exact Jaccard goes beside it.
similar() is the join of all documents: signature bands meet in Spark and every link is verified on whole sets.

A document's next one is found without a sort of the corpus in one task: the ids alone are sorted
into ranges, whose least ids become bounds; texts move once, each to its range, and the first document of a
range also to the one before it (the first of all to the last). A task reads its ranges in order, a
slice of about a MB at a time, and holds one text over to the next slice.

Defined results: null text counts as empty; a text of fewer than five words is one shingle; empty sets have
equal fingerprints and likeness 1 to each other, 0 to others. Documents are in the order of doc_id, rows without
one last; rows of one doc_id are in the order of the md5 of their texts and lie in one range. Repeated rows
each count. A single document is its own next one. No documents give no rows. A very long text is one set,
in memory whole. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mapped, table
from .neardup import minima, near_duplicates, shingle_sets

SHINGLE = 5
MINIMA = 128
#: Ranges of ids for each task, so that tasks of several ranges are about equal.
RANGES = 4
OWN, NEXT, FIRST = 0, 1, 2


def fingerprints(texts: list[bytes], width: int = SHINGLE, n: int = MINIMA) -> tuple[np.ndarray, list[np.ndarray]]:
    """16 bits of the n minima of each text, and the texts' shingle sets."""
    rows = np.cumsum([0, *map(len, texts)])
    sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), rows, width)
    return minima(sets, n).astype(np.uint16), sets


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima, row by row."""
    return np.mean(a == b, axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, after: str) -> str:
    """text whose last half is replaced by as much of the beginning of after."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, place (OWN, or NEXT and FIRST for copies that only follow others) in tasks of whole ranges of
    documents, each in order and each with the document that follows its last one."""
    conf = docs.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL")
    least = ids.repartitionByRange(RANGES * tasks, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id"))
    least = np.array(sorted(r["id"] for r in least.collect()), np.int64)  # one number a range
    bounds, first = least[1:], least[:1]

    @F.pandas_udf("long")
    def placed(ids: pd.Series) -> pd.Series:
        """4 * range, and 2 where it begins one, and 1 where it is the first of all."""
        known = ids.notna().to_numpy()
        x = ids.fillna(0).to_numpy(np.int64)
        at = np.where(known, np.searchsorted(bounds, x, "right"), len(bounds))
        begins = known & (at > 0) & (np.append(bounds, 0)[at - 1] == x) if len(bounds) else np.zeros(len(x), bool)
        leads = known & (x == first[0]) if len(first) else ~known
        return pd.Series(4 * at + 2 * begins + leads)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), placed(F.col("doc_id").cast("long")).alias("code"))
    at = F.floor(F.col("code") / 4)
    copies = F.array(
        F.struct(at.alias("at"), F.lit(OWN).alias("place")),
        F.when(F.floor(F.col("code") / 2) % 2 == 1, F.struct((at - 1).alias("at"), F.lit(NEXT).alias("place"))),
        F.when(F.col("code") % 2 == 1, F.struct(F.lit(len(bounds)).cast("long").alias("at"), F.lit(FIRST).alias("place"))),
    )
    rows = rows.select("doc_id", "text", F.explode(F.array_compact(copies)).alias("to"))
    rows = rows.select("doc_id", "text", "to.at", "to.place").repartition(tasks, "at")
    order = ["at", F.col("place") == FIRST, F.col("doc_id").asc_nulls_last(), F.md5(F.col("text").cast("binary"))]
    return rows.sortWithinPartitions(*order).select("doc_id", "text", "place")


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the exact
    jaccard_edited and jaccard_next, of every row of docs (doc_id, text)."""
    schema = docs.select("doc_id").schema.add("n_chars", "long")
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, "string")
    for name in ("near_edited", "near_next", "jaccard_edited", "jaccard_next"):
        schema = schema.add(name, "double")
    ids = pa.int64() if schema["doc_id"].dataType.simpleString() == "bigint" else None

    def told(held: list[tuple], known: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        """The rows of held but the last, which only follows; its fingerprint and set are for the next call."""
        sig, sets = fingerprints([t.encode() for _, t, _ in held[known is not None :]], width)
        if known is not None:
            sig, sets = np.concatenate([known[0][None], sig]), [known[1], *sets]
        own = [k for k in range(len(held) - 1) if held[k][2] == OWN]
        other = [edited(held[k][1], held[k + 1][1]).encode() for k in own]
        other_sig, other_sets = fingerprints(other, width)
        mine, following = sig[own], sig[[k + 1 for k in own]]
        columns = [
            pa.array([held[k][0] for k in own], ids),
            pa.array([len(held[k][1]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in other], pa.string()),
            pa.array([x.tobytes().hex() for x in mine], pa.string()),
            pa.array([x.tobytes().hex() for x in other_sig], pa.string()),
            pa.array(likeness(mine, other_sig), pa.float64()),
            pa.array(likeness(mine, following), pa.float64()),
            pa.array([jaccard(sets[k], s) for k, s in zip(own, other_sets, strict=True)], pa.float64()),
            pa.array([jaccard(sets[k], sets[k + 1]) for k in own], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names), (sig[-1], sets[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place")), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= SLICE_BYTES and len(held) > 1:
                    out, known = told(held, known)
                    held, size = held[-1:], len(row[1])
                    yield out
        if len(held) > 1:
            yield told(held, known)[0]

    return mapped(_in_ranges(docs), run, schema)


def similar(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents of similarity 0.8 or more are linked, bands of
    minima joined in Spark and every link verified on whole sets (neardup.near_duplicates())."""
    return near_duplicates(docs, width)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
