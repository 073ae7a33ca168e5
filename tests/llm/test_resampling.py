"""Importance resampling against plain Python, n-grams, ties and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataframe.llm.resampling import Resampling, bucket_counts, features, gains, resampled


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _buckets(text, r):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % r.buckets for n in range(1, r.ngrams + 1) for i in range(len(w) - n + 1)]


def _brute(docs, target, r):
    s, t = Counter(b for _, x in docs for b in _buckets(x, r)), Counter(b for x in target for b in _buckets(x, r))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + r.buckets) / ((s[b] + 1) * (sum(t.values()) + r.buckets)))) for b in range(r.buckets)]
    rows = []
    for doc, text in docs:
        found = _buckets(text, r)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{r.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text))])
    may = sorted((x for x in rows if x[4] >= r.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    places = {id(x): k + 1 for k, x in enumerate(may[: len(may) * r.percent // 100])}
    return sorted(((*x[:4], places.get(id(x))) for x in rows), key=repr)


def _documents(n):
    r = np.random.default_rng(3)
    pool = ["Alpha", "beta", "gamma2", "ünï", "日本", "delta", "eps-ilon", "zeta", "eta", "theta"]
    return [(k, " ".join(r.choice(pool, int(r.integers(0, 40))))) for k in range(n)]


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_equals_plain_sums(spark, ngrams):
    r = Resampling(ngrams=ngrams, buckets=97, percent=30)
    docs, target = _documents(120) + [(None, None), (500, ""), (501, "one"), (7, "alpha beta " * 15)], ["alpha beta gamma2", "ALPHA theta", None, ""]
    df, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted(map(tuple, resampled(df, t, r).collect()), key=repr)
    assert got == _brute(docs, target, r)


@pytest.mark.parametrize("ngrams", [1, 2, 4])
def test_features_of_each_text(ngrams):
    r = Resampling(ngrams=ngrams, buckets=1_000)
    texts = ["a b a b a b", "", "x", "a b", "É é A-b", "a " * 50]
    data = "".join(texts).encode()
    of, bucket, n = features(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]), r)
    for k, t in enumerate(texts):
        assert sorted(bucket[of == k].tolist()) == sorted(_buckets(t, r)) and n[k] == len(_words(t))


def test_odd_rows(spark, odd_documents):
    got = resampled(odd_documents, odd_documents).collect()
    assert len(got) == odd_documents.count() and got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[2]["n_features"], by_id[2]["weight"], by_id[2]["rank"]) == (0, 0, None)
    assert by_id[6]["n_features"] == by_id[7]["n_features"] == 24_000 and by_id[6]["weight"] == by_id[7]["weight"]


def test_no_documents_or_no_target(spark, odd_documents, no_documents):
    assert resampled(no_documents, odd_documents).count() == 0
    assert set(gains(odd_documents, no_documents, Resampling(buckets=10)).tolist()) != set()
    assert gains(no_documents, no_documents).tolist() == [0] * 10_000


def test_repeated_rows_may_each_be_drawn(spark):
    df = spark.createDataFrame([(1, "w " * 30)] * 20, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resampled(df, df).collect() if r["rank"])
    assert ranks == [1, 2]


def test_what_a_task_returns_is_bounded(spark):
    df = spark.range(3_000).selectExpr("concat('w', id) AS text")
    counts = bucket_counts(df, Resampling(buckets=16))
    assert counts.count() == 16 and counts.groupBy().sum("n").first()[0] == 3_000
