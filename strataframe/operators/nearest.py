"""Nearest neighbours by cosine similarity: exact in blocks, and by an inverted-file index.

Both deal rows and queries into blocks and let each block of rows meet each block of queries that asks for it in one
task, as a matrix product; a task returns the best of its own for each query, and those are merged. The exact
search is one list of all rows. The index cuts rows into lists around centroids that k-means finds on a
bounded sample; a query asks only for the lists with the nearest centroids. A list with many rows (copies of
one vector, say) is many blocks, so no task takes a list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows, and queries, that meet in one task, about; similarities that are computed at once.
BLOCK, QUERIES, AT_ONCE = 1 << 16, 1 << 12, 1 << 22
#: Vectors that centroids are fitted on, at most; lists at most; rounds of k-means.
SAMPLE, LISTS, ROUNDS = 20_000, 1_024, 12
#: Similarities that are equal to so many digits are ties, and the smaller id is the nearer.
DIGITS = 9


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v of the rows with an id and a vector that has a direction."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & whole)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its k highest scores, ties to smaller ids, as (row, place) arrays."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), -np.inf)
    rows, places = np.nonzero(scores >= least[:, None])  # ties at the end make it more than k
    order = np.lexsort((ids[places], -scores[rows, places], rows))
    rows, places = rows[order], places[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], places[nth < k]


def _met(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if rows.num_rows and asked.num_rows:
            x, q = _matrix(rows["v"]), _matrix(asked["v"])
            ids, of = rows["id"].to_numpy(), asked["id"].to_numpy()
            step = max(1, AT_ONCE // len(x))
            for a in range(0, len(q), step):
                scores = np.round(q[a : a + step] @ x.T, DIGITS)
                r, p = _best(scores, ids, k)
                for found, more in zip(out, (of[a + r], ids[p], scores[r, p]), strict=True):
                    found.append(more)
        return pa.table([np.concatenate(c) for c in out], names=["query_id", "id", "similarity"])

    return run


def _searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """rows: list, id, v. asked: list, id, v (a query once for each list). query_id, id, similarity, place of the k best."""
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
    block = lambda n, of: F.ceil(F.col(n) / F.lit(of)).cast("int")
    sizes = F.broadcast(sizes.select("list", block("n", BLOCK).alias("parts"), block("q", QUERIES).alias("asks")))  # LISTS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.join(sizes, "list").withColumn("part", own("parts")).withColumn("ask", every("asks")).select("list", "part", "ask", "id", "v")
    right = asked.join(sizes, "list").withColumn("ask", own("asks")).withColumn("part", every("parts")).select("list", "part", "ask", "id", "v")
    key = ["list", "part", "ask"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_met(k), "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest_exact(df: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 10) -> DataFrame:
    """query_id, id, similarity, place (1 to k): the rows of df nearest to each query, by cosine similarity, ties by id.

    Every query meets every row, in blocks. Rows without an id, and vectors that are null, hold a null or
    have no direction are neither found nor ask. All vectors must have one length. Ids must be different."""
    one = F.lit(0).alias("list")
    return _searched(_usable(df, id_column, vector).select(one, "id", "v"), _usable(queries, id_column, vector).select(one, "id", "v"), k)


@dataclass(frozen=True)
class Index:
    """centroids: a unit vector for each list. rows: list, id, v of every usable row, written. probes: lists a query
    asks for; told: the share of true neighbours that so many lists held, on the sample."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    told: float

    def search(self, queries: DataFrame, id_column: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
        """As nearest_exact(), among the rows of the lists that are nearest to each query."""
        asked = _placed(_usable(queries, id_column, vector), self.centroids, min(probes or self.probes, len(self.centroids)))
        return _searched(self.rows, asked, k)


def _placed(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows (id, v) once for each of the n nearest centroids (list)."""

    def run(batches):
        for b in batches:
            near = np.argsort(-(_matrix(b.column("v")) @ centroids.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *(b.column(c).take(at) for c in ("id", "v"))], names=["list", "id", "v"])

    schema = rows.select(F.lit(0).alias("list"), "id", "v").schema
    return rows.mapInArrow(run, schema) if len(centroids) else rows.select(F.lit(0).alias("list"), "id", "v")


def _means(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of x by spherical k-means, begun at different vectors of x."""
    r = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    c = different[r.permutation(len(different))[:lists]]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        long = np.linalg.norm(sums, axis=1)
        c = np.where(long[:, None] > 0, sums / np.where(long, long, 1)[:, None], c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, target: float) -> tuple[int, float]:
    """The fewest lists that hold target of the k nearest vectors of up to a thousand of x, and what they hold."""
    asked = x[: min(len(x), 1_000)]
    rows, near = _best(np.round(asked @ x.T, DIGITS), np.arange(len(x)), k)
    ranked = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # the place of each list for each query
    needs = np.sort(ranked[rows, np.argmax(x @ c.T, axis=1)[near]])
    held = np.searchsorted(needs, np.arange(len(c)), "right") / len(needs)
    n = int(np.argmax(held >= target)) + 1
    return n, float(held[n - 1])


def fit_index(df: DataFrame, id_column: str, vector: str, k: int = 10, target: float = 0.97, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """Fits centroids on the sample vectors of the smallest hashes of their ids, puts every row into the list of its nearest
    centroid and writes the lists. lists: the root of the sample's size, if not given. probes are the fewest that
    hold target of the sample's own neighbours."""
    rows = _usable(df, id_column, vector)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # sample rows at most
    x = _matrix(some["v"])
    if not len(x):
        return Index(np.zeros((0, 1)), written(rows.select(F.lit(0).alias("list"), "id", "v"), "index"), 1, 1.0)
    c = _means(x, min(lists or max(1, round(len(x) ** 0.5)), LISTS), seed)
    probes, told = _probes(x, c, k, target)
    return Index(c, written(_placed(rows, c, 1).repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))), "index"), probes, told)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (query_id, id) that found has."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    n, hits = both.agg(F.count(F.lit(1)), F.count("hit")).first()
    return hits / n if n else 1.0
