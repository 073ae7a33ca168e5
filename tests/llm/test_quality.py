from __future__ import annotations

import re

import numpy as np
import pytest

from strataframe.llm import quality as op
from strataframe.llm.common import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {c: r[c] for c in op.BASE} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed and (not r["kept"] or not failed) and r["kept"] == (not failed and r["rule"] == 0)


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = op.op9_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_learned_list_agrees_with_labels_it_has_not_seen(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    held = op.F.pmod(op.F.crc32(op.F.col("doc_id").cast("string").cast("binary")), op.F.lit(5)) == 0
    truth = {r["doc_id"]: r["quality"] for r in labels.filter(held).collect()}
    got = [(r["kept"], truth[r["doc_id"]]) for r in op.judged(docs, labels.filter(~held), ["doc_id"]).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good, bad = [k for k, y in got if y == 1], [k for k, y in got if y == 0]
    assert len(good) > 200 and len(bad) > 10
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_one_text_teaches_for_each_label(spark):
    long = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, long + " more" * k) for k in range(6)] + [(2, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    seen = []
    real = op.learn
    try:
        op.learn = lambda x, bad, fold: seen.append(bad.tolist()) or real(x, bad, fold)
        op.learned(docs, labels)
    finally:
        op.learn = real
    assert sorted(seen[0]) == [False, False, True]


def test_repeats_overlap_and_stop_at_texts(spark):
    base = [f"w{k}" for k in range(12)]
    texts = {0: " ".join(base + base), 1: " ".join(base[:8] + ["x"] + base[:8]), 2: " ".join(base), 3: " ".join(["a"] * 30), 4: " ".join(base[:7] * 2), 5: "a\n\nb\na\n \nb\na", 6: None, 7: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in op.with_statistics(df, ["doc_id"]).collect():
        assert {c: r[c] for c in op.BASE} == brute(texts[r["doc_id"]])


def test_hash_collisions_are_told_apart(monkeypatch):
    words = op.Words(np.frombuffer(b" ".join([b"a", b"b"] * 12 + [b"c"] * 3), np.uint8), np.array([0, 53]))
    _, index = words.coded()
    want = op._repeated(words, index)
    monkeypatch.setattr(op, "mixed", lambda h: h & np.uint64(1))
    assert op._repeated(words, index).tolist() == want.tolist()


def test_rules_are_learned_in_order_and_leave_as_one_expression(spark):
    r = np.random.default_rng(0)
    x = {f: r.random(600) for f in op.FEATURES}
    bad = (x["mean_word"] > 0.8) | ((x["n_words"] < 0.2) & (x["upper_per_char"] > 0.5))
    rules = op.learn(x, bad, np.arange(600) % 3 == 0)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= op._covers(rule, x, 600)
    assert (hit == bad).mean() > 0.93 and (hit & ~bad).sum() < 12 and 1 <= len(rules) <= 6
    assert op.learn(x, np.zeros(600, bool), np.arange(600) % 3 == 0) == []
    assert str(op.verdict([])) == str(op.F.lit(0))


@pytest.mark.parametrize("prefix", ["", "q_"])
def test_odd_rows(spark, odd_documents, no_documents, labels, prefix):
    got = op.judged(odd_documents, labels, ["doc_id", "text"], prefix or "s_").collect()
    assert len(got) == odd_documents.count()
    assert all(not r[f"{prefix or 's_'}kept"] for r in got if not r["text"])
    assert op.judged(no_documents, labels, ["doc_id"]).count() == 0
    assert op.judged(odd_documents, labels.limit(0), ["doc_id"]).filter("rule > 0").count() == 0
