"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, pairs of neighbours and pairs with one
or two words between. A bounded sample of labelled rows (SAMPLE, those of the smallest hashes, and SAMPLE_FEATURES,
of which a text takes SHARE at most) teaches the model in one task: each coordinate has its own rate, and the L1 term keeps all but
some hundred weights at zero; a fifth of it sets the scores' slope and bias. The weights that are left go to every task with the function
that scores, at most BUCKETS of them; a text's score needs a look at each of its features only.

Defined results: words are runs of bytes other than ASCII blanks, controls and punctuation, A-Z
in lower case; null or empty text has no features and scores the model's bias; without
labelled rows of both classes every score is 0. Rows are kept one for one, repeated rows and null
doc_id included. A doc_id with several labels counts as so many rows of the sample, and
of a doc_id with several texts the one with the fewest features teaches (ties by their hash); null labels don't count. Very long texts are scored whole, one in memory at a time; one of more features than SHARE teaches by those of the smallest hashes, from all of the text. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, made_folders
from .common import Words, crc32_of, lowered, mapped, materialize, mixed, slices, table, word_hashes

#: Labelled rows that teach the model, at most.
SAMPLE = 16_000
#: Features of the rows that teach it, at most (256 MB): rows in the order of their hashes, up to this sum.
SAMPLE_FEATURES = 1 << 26
#: Features of one text that teach, at most, so that long texts leave room for 1,024 rows or more.
SHARE = 1 << 16
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Words between the two of a pair, from none.
SKIPS = (0, 1, 2)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: One row in so many isn't learned from but sets the slope and bias of the scores.
CALIBRATED = 5
FOLDS = 5

_PART = np.zeros(256, bool)
_PART[:128] = [not chr(c).isalnum() for c in range(128)]


def _features(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the row of each, for each kind of feature."""
    words = Words(lowered(data), rows, _PART)
    h = word_hashes(words)
    doc = np.repeat(np.arange(len(words.n)), words.n)
    shift = np.uint64(64 - BUCKET_BITS)
    yield (h >> shift).astype(np.int64), doc
    for skip in SKIPS:
        n = len(h) - skip - 1
        if n > 0:
            pair = mixed(h[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * skip) + h[skip + 1 :])
            same = doc[:n] == doc[skip + 1 :]
            yield (pair >> shift).astype(np.int64)[same], doc[:n][same]


def feature_lists(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    n = len(rows) - 1
    keys = np.unique(np.concatenate([doc << BUCKET_BITS | b for b, doc in _features(data, rows)]))
    at = np.searchsorted(keys, np.arange(n + 1) << BUCKET_BITS)
    keys = (keys & (BUCKETS - 1)).astype(np.uint32)
    return [keys[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def shared(buckets: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The buckets of a text that teach: all, or the share of them that have the smallest hashes."""
    if len(buckets) <= share:
        return buckets
    return np.sort(buckets[np.argpartition(mixed(buckets.astype(np.uint64)), share)[:share]])


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> Ftrl:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets.astype(np.int64), BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def calibrated(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and bias that make sigmoid(slope * x + bias) most likely (Newton's steps, held back by a
    weak pull to slope 1 and bias 0); 1 and 0 where a class has no rows."""
    slope, bias = 1.0, 0.0
    if len(np.unique(label)) < 2:
        return slope, bias
    x = np.clip(x, -35, 35)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -35, 35)))
        g, h = p - label, p * (1 - p)
        gradient = np.array([(g * x).sum() + slope - 1, g.sum() + bias * 0.1])
        hessian = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max())
        slope, bias = slope - step[0], bias - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(slope), float(bias)) if slope > 0 else (1.0, 0.0)


def trained(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (BUCKETS is the bias) and their weights other than zero. rows: in the order of learning."""
    model = Ftrl.fresh()
    order = np.random.Generator(np.random.PCG64(5))
    if len({label for _, label in rows}) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    learned = [r for k, r in enumerate(rows) if k % CALIBRATED]
    for _ in range(epochs):
        for k in order.permutation(len(learned)):
            model.learn(*learned[k])
    w = model.weights(np.arange(BUCKETS + 1))
    rest = rows[::CALIBRATED]
    slope, bias = calibrated(np.array([w[f].sum() + w[BUCKETS] for f, _ in rest]), np.array([label for _, label in rest]))
    w *= slope
    w[BUCKETS] += bias
    at = np.flatnonzero(w)
    return at, w[at]


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, share: int = SHARE) -> DataFrame:
    """doc_id, toxic, features (uint32, at most share a text) of at most sample labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) != 0))
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = rows.select("doc_id", "toxic").schema.add("features", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                made = [shared(x, share).tobytes() for x in feature_lists(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(made, pa.binary())], names=schema.names)

    made = mapped(rows, run, schema).groupBy("doc_id", "toxic")
    return made.agg(F.min_by("features", F.struct(F.octet_length("features"), F.xxhash64("features"))).alias("features"))


def model_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = SAMPLE_FEATURES, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The weights, learned in one task from the bounded sample; only those other than zero leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], features
        for batch in batches:
            for buckets, label in zip(batch.column("features"), batch.column("toxic"), strict=True):
                left -= len(buckets.as_buffer()) // 4
                if left >= 0:
                    rows.append((np.frombuffer(buckets.as_py(), np.uint32), label.as_py()))
        at, w = trained(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    rows = labelled_features(docs, labels, sample, share).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("features"))
    before = made_folders()
    got = materialize(mapped(rows, run, "at long, w double"), "toxicity-weights").toPandas()
    discard(docs.sparkSession, before)
    return got["at"].to_numpy(), got["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """carry and score (0 to 1) of every row of docs."""
    at, w = model
    schema = docs.select(*carry).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BUCKETS + 1)
        dense[at] = w
        used = dense != 0
        for batch in batches:
            for part, data, rows in slices(batch, text):
                keys = []
                for buckets, doc in _features(data, rows):
                    hit = np.flatnonzero(used[buckets])
                    keys.append(doc[hit] << BUCKET_BITS | buckets[hit])
                keys = np.unique(np.concatenate(keys))
                total = dense[BUCKETS] + np.bincount(keys >> BUCKET_BITS, dense[keys & (BUCKETS - 1)], part.num_rows)
                scores = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(scores)], names=schema.names)

    return mapped(docs.select(*carry, *[text][text in carry :]), run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, model_of(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
