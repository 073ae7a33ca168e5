from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import xxhash

from strataframe.llm import toxicity as op


def corpus(spark, n=900):
    r = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "po") for b in ("ra", "st", "un", "vel", "wex", "yo")]
    rows, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randrange(20, 60))]
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["fie", "scum!", "Wretch"]))
        rows.append((k, " ".join(text), "en", "s"))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = op.model_of(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [(r["score"], truth[r["doc_id"]]) for r in op.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in got]) > 0.97
    assert len(model[0]) < 2_000


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(spark, 300)
    from pyspark.sql import functions as F

    held = F.pmod(op.crc32_of("doc_id"), F.lit(op.FOLDS)) == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = op.model_of(docs, labels), op.model_of(docs, other)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_features_are_words_pairs_and_skips():
    data = np.frombuffer(b"A b, c d" + b"a" + b"", np.uint8)
    lists = op.feature_lists(data, np.array([0, 8, 9, 9]))
    assert [len(x) for x in lists] == [4 + 3 + 2 + 1, 1, 0]
    assert lists[1][0] in lists[0]  # A and a are one word


def test_calibration_is_the_most_likely_line():
    x = np.linspace(-4, 4, 2001)
    y = (np.random.default_rng(0).random(2001) < 1 / (1 + np.exp(-(2 * x + 1)))).astype(int)
    slope, bias = op.calibrated(x, y)
    assert abs(slope - 2) < 0.4 and abs(bias - 1) < 0.3
    assert op.calibrated(x, np.zeros(2001, int)) == (1.0, 0.0)


def test_odd_rows(spark, odd_documents, no_documents, labels):
    model = op.model_of(odd_documents, labels)
    got = op.score(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op.score(no_documents, model).count() == 0
    none = op.model_of(odd_documents, labels.limit(0))
    assert len(none[0]) == 0 and {r["score"] for r in op.score(odd_documents, none).collect()} == {0.0}


def plain_features(text):
    """The buckets of a text, one word, pair and skip-pair at a time."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h, mask, out = [xxhash.xxh64_intdigest(w.encode()) for w in words], 2**64 - 1, set()

    def spread(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out.update(x >> 64 - op.BUCKET_BITS for x in h)
    for skip in op.SKIPS:
        out.update(spread(h[k] * (0x9E3779B97F4A7C15 + 2 * skip) + h[k + skip + 1] & mask) >> 64 - op.BUCKET_BITS for k in range(len(h) - skip - 1))
    return sorted(out)


def plain_ftrl(rows, order):
    """FTRL-proximal as published: one coordinate at a time, in a dictionary."""
    z, n, w = {}, {}, {}
    for k in order:
        features, label = rows[k]
        at = [*features, op.BUCKETS]
        for i in at:
            zi, l1 = z.get(i, 0.0), 0.0 if i == op.BUCKETS else op.L1
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((op.BETA + math.sqrt(n.get(i, 0.0))) / op.ALPHA + op.L2)
        g = 1 / (1 + math.exp(-sum(w[i] for i in at))) - label
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / op.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: -(zi - math.copysign(l1, zi)) / ((op.BETA + math.sqrt(n[i])) / op.ALPHA + op.L2) for i, zi in z.items() if abs(zi) > (l1 := 0.0 if i == op.BUCKETS else op.L1)}


def test_features_and_weights_equal_brute_force():
    r = random.Random(2)
    texts = [" ".join(r.choice(["Ab", "cd,", "ef", "Gü", "h1", "ij!"]) for _ in range(r.randrange(0, 30))) for _ in range(200)]
    data = [t.encode() for t in texts]
    lists = op.feature_lists(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [x.tolist() for x in lists] == [plain_features(t) for t in texts]
    rows = [(x, int("ef ij" in t or "Gü" in t[:4])) for x, t in zip(lists, texts, strict=True)]
    learned = [x for k, x in enumerate(rows) if k % op.CALIBRATED]
    order = np.random.Generator(np.random.PCG64(5))
    want = plain_ftrl([(x.tolist(), y) for x, y in learned], [k for _ in range(op.EPOCHS) for k in order.permutation(len(learned))])
    at, w = op.trained(rows)
    some = [k for k in at.tolist() if k != op.BUCKETS]
    assert some and some == sorted(k for k in want if k != op.BUCKETS)
    slope = w[0] / want[some[0]]
    assert np.allclose(w[: len(some)], [slope * want[k] for k in some], rtol=1e-6)


def test_query_has_every_document_and_its_score(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at, w = op.model_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    got = op.op5_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and got[0].__fields__[:4] == ["doc_id", "held_out", "score", "predicted"]
    for r in got:
        total = weights.get(op.BUCKETS, 0.0) + sum(weights.get(k, 0.0) for k in plain_features(docs[r["doc_id"]] or ""))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


def test_features_of_the_sample_are_bounded(spark):
    docs, labels = corpus(spark, 300)
    assert len(op.model_of(docs, labels, features=3)[0]) == 0  # no row fits
    few, all_ = op.model_of(docs, labels, features=20_000), op.model_of(docs, labels)
    assert 0 < len(few[0]) and few[1].tolist() != all_[1].tolist()


def test_long_texts_leave_room_for_others(spark):
    docs, labels = corpus(spark, 300)
    r = random.Random(3)
    long = [(1_000 + k, " ".join(f"w{r.randrange(1 << 40)}" for _ in range(4_000)), "en", "s") for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame(long, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(k, 1, 0) for k, *_ in long], labels.schema))
    lengths = {x["doc_id"]: len(x["features"]) // 4 for x in op.labelled_features(docs, labels, share=500).collect()}
    assert max(lengths.values()) == 500 and lengths[1_003] == 500 and all(n < 500 for k, n in lengths.items() if k < 1_000)
    at, w = op.model_of(docs, labels, features=100_000, share=500)
    truth = {k: int(k % 5 == 0) for k in range(300)}
    got = [((x["score"] >= 0.5) == truth[x["doc_id"]]) for x in op.score(docs, (at, w)).filter("doc_id < 1000").collect()]
    assert np.mean(got) > 0.9


def test_the_share_comes_from_all_of_a_text():
    data = " ".join(f"w{k}" for k in range(3_000)).encode()
    whole = op.feature_lists(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    some = op.shared(whole, 1_000)
    assert len(some) == 1_000 and set(some) <= set(whole) and some.tolist() == sorted(some) and some.dtype == whole.dtype
    assert op.shared(whole[:1_000], 1_000).tolist() == whole[:1_000].tolist()
    assert abs(np.mean(some) / np.mean(whole) - 1) < 0.1  # the bucket's place doesn't choose
