"""Importance resampling towards a target distribution of hashed word n-grams.

A task gives each distinct word of some texts an integer id; an n-gram is a tuple of ids, and tuples are
numbered in turn (the id of a tuple's first n-1 words and that of its last word). Each distinct tuple's
bytes are put together from the dictionary and hashed once, and the bucket goes back to every place
where the tuple stands. Bucket counts of all documents and of the target are sums of the tasks' own, BUCKETS
numbers each, so neither words nor n-grams move. A bucket's gain is the log-ratio of its
smoothed frequencies; a document's weight is the mean gain of its features.

Documents are drawn without replacement by Gumbel noise from a hash of their id: the highest sums of
weight and noise. Their order is found by range partitions (operators/scans.py), without one task for all.

Defined results: null text has no words, weight 0 and no rank. A row without doc_id is scored as if its id
were empty text and comes last among equal scores. Repeated rows each count, and may be drawn, each. A target
or a corpus without features smooths to equal frequencies. No documents give no rows. Very long texts are
read where they lie; other columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import ranks
from .common import Words, lowered, mapped, materialize, slices, table

#: Bytes that part words, after A-Z is lowered: ASCII other than digits and letters.
PART = np.zeros(256, bool)
PART[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@dataclass(frozen=True)
class Resampling:
    """ngrams: longest run of words; least_words: documents of fewer aren't drawn; percent: of those that may be."""

    ngrams: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def features(data: np.ndarray, rows: np.ndarray, r: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of every feature of some texts, and each text's number of words."""
    words = Words(lowered(data), rows, PART)
    distinct, ids = words.coded()
    names = distinct.to_pylist()
    text = np.repeat(np.arange(len(words.n)), words.n)
    bucket = np.fromiter((zlib.crc32(w) % r.buckets for w in names), np.int64, len(names))
    texts, buckets = [text], [bucket[ids] if len(ids) else ids]
    tuples, starts = ids, np.arange(len(ids))
    for n in range(2, r.ngrams + 1):
        inside = np.flatnonzero((starts + n <= len(ids)) & (text[np.minimum(starts + n - 1, len(ids) - 1)] == text[starts])) if len(starts) else starts
        starts, pairs = starts[inside], tuples[inside] * (len(names) + 1) + ids[starts[inside] + n - 1]
        _, first, tuples = np.unique(pairs, return_index=True, return_inverse=True)
        hashed = (zlib.crc32(b" ".join([names[w] for w in ids[at : at + n]])) % r.buckets for at in starts[first].tolist())
        bucket = np.fromiter(hashed, np.int64, len(first))
        texts.append(text[starts])
        buckets.append(bucket[tuples] if len(starts) else starts)
    return np.concatenate(texts), np.concatenate(buckets), words.n


def bucket_counts(docs: DataFrame, r: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """bucket, n: how many features of docs fall in it, for those with any. A task returns a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(r.buckets, np.int64)
        for batch in batches:
            for _, data, rows in slices(batch, text):
                counts += np.bincount(features(data, rows, r)[1], minlength=r.buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["bucket", "n"])

    return mapped(docs.select(text), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, r: Resampling = Resampling()) -> np.ndarray:
    """The gain of each bucket: a thousand log-ratios of the smoothed frequencies, floored. It brings 2 * r.buckets rows to the driver."""
    counts = []
    for df in (docs, target):
        found = np.zeros(r.buckets)
        for row in bucket_counts(df, r).collect():
            found[row["bucket"]] = row["n"]
        counts.append(found)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + r.buckets) / ((s + 1) * (t.sum() + r.buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, r: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of the features) of every document."""
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, text):
                of, bucket, words = features(data, rows, r)
                n = np.bincount(of, minlength=part.num_rows)
                # sums of whole numbers below 2**53 are exact in doubles
                total = np.bincount(of, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], names=schema.names)

    return mapped(docs.select("doc_id", text), run, schema)


def resampled(docs: DataFrame, target: DataFrame, r: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); rank is null for those that aren't drawn."""
    key = F.concat(F.lit(f"{r.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weighed(docs, gains(docs, target, r), r).withColumn("score", F.col("weight") + noise)
    rows = materialize(rows.withColumn("may", F.col("n_words") >= r.least_words), "weights")
    drawn = rows.filter("may").count() * r.percent // 100
    down = lambda x: x.desc()
    placed = ranks(rows, [], [(F.col("may"), down), (F.col("score"), down)], [F.col("doc_id").asc_nulls_last()])
    rank = F.when(F.col("may") & (F.col("_row") <= F.lit(drawn)), F.col("_row"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The table of crc32's 256 remainders, for crc32_sql().
CRC32_SQL = """
    crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS remainders FROM range(256) t(i))"""


def crc32_sql(bytes_hex: str) -> str:
    """crc32 of a column of hexadecimal bytes, beside the one row of crc_table."""
    steps = f"[CAST('0x' || substr({bytes_hex}, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) for i in range(1, length({bytes_hex}) // 2 + 1)]"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c // 256, remainders[CAST(xor(c % 256, b) AS BIGINT) + 1]), 4294967295), 4294967295)"


def _oracle() -> str:
    r = Resampling()
    low = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH {CRC32_SQL.strip()},
    docs AS (SELECT row_number() OVER () AS r, doc_id, {low} AS w FROM documents),
    items AS (SELECT {low} AS w FROM benchmark),
    own AS (SELECT r, unnest(w) AS w FROM docs), other AS (SELECT unnest(w) AS w FROM items),
    hashed AS (SELECT w, CAST({crc32_sql("x")} % {r.buckets} AS BIGINT) AS b FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION SELECT w FROM other)), crc_table),
    s AS (SELECT b, count(*) AS n FROM own JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM other JOIN hashed USING (w) GROUP BY b),
    both_sums AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM other) AS t_all),
    gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {r.buckets}) / ((s.n + 1)::DOUBLE * (t_all + {r.buckets})))) AS BIGINT) AS g FROM s LEFT JOIN t ON s.b = t.b, both_sums),
    sums AS (SELECT r, count(*) AS n, sum(g) AS g FROM own JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
    scored AS (SELECT docs.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(g / n), 0) AS BIGINT) AS weight,
      CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{r.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM docs LEFT JOIN sums ON docs.r = sums.r),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {r.least_words} ORDER BY weight + noise DESC, doc_id) AS place FROM scored)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
      CASE WHEN n_features >= {r.least_words} AND place <= (SELECT count(*) * {r.percent} // 100 FROM scored WHERE n_features >= {r.least_words}) THEN place END AS rank FROM placed
    """


ORACLE = _oracle()
