"""Fingerprints against plain Python: order, edited texts, likeness, exact Jaccard."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from strataframe.llm import fingerprints as fp


def _shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _held_against_plain(got, rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 2
        e = t[: len(t) - n] + after[:n]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(_jaccard(t, e), 9), round(_jaccard(t, after), 9)))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["jaccard_edited"], 9), round(r["jaccard_next"], 9)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(5)
    pool = [f"word{k}" for k in range(60)] + ["Ünï", "日本語", "\U0001f600"]
    out = []
    for k in range(230):
        own = list(r.choice(pool, int(r.integers(0, 120))))
        out.append((int(r.integers(0, 10**12)) if k % 3 else k, " ".join(own)))
        if k % 9 == 0:  # the next one is nearly the same
            out.append((out[-1][0] + 1, " ".join([*own, "end"])))
    return out


def test_equals_plain(spark, texts, monkeypatch):
    monkeypatch.setattr(fp, "SLICE_BYTES", 2_000)
    got = fp.fingerprinted(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    _held_against_plain(got, texts)
    for name in ("edited", "next"):
        off = np.array([r[f"near_{name}"] - r[f"jaccard_{name}"] for r in got])
        assert np.abs(off).max() < 0.25 and np.abs(off.mean()) < 0.02


def test_odd_rows(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = fp.fingerprinted(odd_documents).collect()
    _held_against_plain(got, rows)
    prints = {}
    for r in got:
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)} == {next(r["fingerprint"] for r in got if r["doc_id"] == 6)}
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3)} == {"f" * 4 * fp.MINIMA}


@pytest.mark.parametrize("rows", [[], [(4, "a b c d e f")], [(None, "x y"), (None, None)], [(1, "one two")] * 7, [(None, "z z z z z z"), (-5, "q"), (9, "r s")]])
def test_few_rows(spark, rows):
    _held_against_plain(fp.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_similar_documents_are_linked(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(1, base), (2, base + " more"), (3, base), (4, "other text of its own kind here"), (5, None)]
    got = {r["doc_id"]: r["component_id"] for r in fp.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_texts_move_once(spark, sf_dir):
    import contextlib
    import io

    from strataframe.llm import registry

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()["op12_fingerprints"](spark, sf_dir).explain("formatted")
    assert out.getvalue().count("hashpartitioning") == 1 and "rangepartitioning" not in out.getvalue() and "SinglePartition" not in out.getvalue()
