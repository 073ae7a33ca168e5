from __future__ import annotations

import duckdb
import numpy as np
import pytest

from strataframe.llm import mixing as op


def corpus(spark, n=4000):
    r = np.random.default_rng(0)
    langs, extra = ["en", "de", "fr", "es", "pt"], ["", " mail a@b.c", " a | b", " license"]
    rows = [(k, "word " * int(r.integers(1, 60)) + extra[int(r.integers(0, 4) * (r.random() < 0.4))], langs[min(4, int(r.exponential(1)))], f"s{min(6, int(r.exponential(1)))}", 1) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_marginals_are_met(spark):
    docs, t = corpus(spark), op.Targets(budget=0.002)
    got = op.mixed_documents(docs, t).toPandas()
    got["w"] = got["n_tokens"] * got["probability"]
    total = got["w"].sum()
    assert abs(total / got["n_tokens"].sum() - 0.002) < 1e-6
    assert got["probability"].max() < 1  # else the marginals give way to the cap
    by = (got.groupby("topic")["w"].sum() / total).to_dict()
    assert all(abs(by[k] - v) < 1e-6 for k, v in t.topics.items())
    by = (got.groupby("lang")["w"].sum() / total).to_dict()
    assert all(abs(by[k] - t.languages[k]) < 1e-4 for k in ("en", "de", "fr", "es")) and abs(by["pt"] - t.languages["other"]) < 1e-4
    root = np.sqrt(got.groupby("source")["n_tokens"].sum())
    assert np.allclose(got.groupby("source")["w"].sum() / total, root / root.sum(), atol=1e-3)
    kept = got[got["sampled"]]["n_tokens"].sum() / got["n_tokens"].sum()
    assert abs(kept - 0.002) < 0.003


@pytest.mark.parametrize("t", [op.Targets(), op.Targets(bounded=True), op.Targets(budget=0.7, bounded=True), op.Targets(budget=0.95), op.Targets(budget=0.3, source_power=0.0, source_weights={"s1": 3.0})])
def test_equals_sql(spark, t):
    docs = corpus(spark, 500)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[3:7] for r in con.execute(op.oracle(t=t)).fetchall()}
    got = {r["doc_id"]: (r["topic"], r["n_tokens"], round(r["probability"], 6), r["sampled"]) for r in op.mixed_documents(docs, t).collect()}
    assert got == want


def reached(got, by):
    w = got["n_tokens"] * got["probability"]
    return (w.groupby(got[by]).sum() / w.sum()).to_dict()


@pytest.mark.parametrize("budget,few", [(0.5, 0), (0.5, op.FEW), (0.7, op.FEW)])
def test_bounded_marginals_are_met_where_cells_are_full(spark, budget, few, monkeypatch):
    monkeypatch.setattr(op, "FEW", few)
    t = op.Targets(budget=budget, bounded=True, languages={"en": 0.60, "de": 0.25, "fr": 0.10, "es": 0.03, op.REST: 0.02}, topics={"legal": 0.13, "contact": 0.12, "table": 0.11, "prose": 0.64})
    docs = corpus(spark)
    got = op.mixed_documents(docs, t).toPandas()
    full = got["probability"] > 1 - 1e-9
    assert 0.01 < full.mean() < 1 and got["probability"].max() <= 1
    assert abs((got["n_tokens"] * got["probability"]).sum() / got["n_tokens"].sum() - budget) < 1e-6
    assert all(abs(reached(got, "topic")[k] - v) < 1e-5 for k, v in t.topics.items())
    assert all(abs(reached(got, "lang").get({op.REST: "pt"}.get(k, k), 0) - v) < 1e-5 for k, v in t.languages.items())
    total = got.groupby("source")["n_tokens"].sum().astype(float)
    want = op._within(np.sqrt(total.to_numpy()), total.to_numpy(), budget * total.sum()) / (budget * total.sum())
    assert np.allclose([reached(got, "source")[k] for k in total.index], want, atol=1e-5)


@pytest.mark.parametrize("budget", [0.5, 0.7])
def test_what_the_budget_cannot_meet_is_full_and_told(spark, budget, caplog):
    got = op.mixed_documents(corpus(spark), op.Targets(budget=budget, bounded=True, topics={"legal": 0.1, "contact": 0.4, "table": 0.1, "prose": 0.4})).toPandas()
    have = (got.groupby("topic")["n_tokens"].sum() / got["n_tokens"].sum()).to_dict()
    assert have["contact"] < 0.4 * budget
    assert abs(reached(got, "topic")["contact"] - have["contact"] / budget) < 1e-5
    assert any("'contact'" in r.getMessage() and "wanted 0.4000" in r.getMessage() for r in caplog.records)


def test_contradicting_marginals_give_probabilities(spark):
    rows = [(k, "word " * 5 + " license" * (k % 2), ["en", "de"][k % 2], f"s{k % 2}", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = op.fit(docs, op.Targets(budget=0.7, bounded=True, languages={"en": 0.9, "de": 0.1}, topics={"legal": 0.5, "prose": 0.5}, signs={"legal": ("icense",)}))
    assert np.isfinite(mix.cells).all() and all(np.isfinite(r["a"]) and r["a"] > 0 for r in mix.sources.collect())
    assert mix.shares and all(0 <= x[3] <= 1 for x in mix.shares)


def test_sample_is_what_the_mix_says(spark):
    docs = corpus(spark, 800)
    mixed = {r["doc_id"] for r in op.mixed_documents(docs).filter("sampled").collect()}
    kept = op.sample_documents(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == mixed


def test_odd_rows(spark, odd_documents, no_documents):
    got = op.mixed_documents(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(0 <= r["probability"] <= 1 for r in got)
    twice = [r["probability"] for r in got if r["doc_id"] == 1 and r["n_tokens"] == 12]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert op.sample_documents(odd_documents).schema == odd_documents.schema
    assert op.mixed_documents(no_documents).count() == 0 and op.sample_documents(no_documents).count() == 0
    blank = odd_documents.filter("text IS NULL OR text = ''")
    assert {r["probability"] for r in op.mixed_documents(blank).collect()} == {0.0}


def test_a_column_may_name_the_topics(spark):
    docs = corpus(spark, 600)
    t = op.Targets(topics={"s0": 0.2, "s1": 0.3, "else": 0.5}, topic_column="source", bounded=True, budget=0.1)
    got = op.mixed_documents(docs, t).toPandas()
    named = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert all(r.topic == (named[r.doc_id] if named[r.doc_id] in ("s0", "s1") else "else") for r in got.itertuples())


def test_shares_are_in_the_result(spark):
    got = op.mixed_documents(corpus(spark), op.Targets(bounded=True, budget=0.05)).toPandas()
    for by, column in (("topic", "topic_reached"), ("lang", "language_reached")):
        told = got.groupby(by)[column].first().to_dict()
        assert all(abs(reached(got, by)[k] - v) < 1e-9 for k, v in told.items())
    assert (abs(got["topic_wanted"] - got["topic_reached"]) < 1e-3).all()


@pytest.mark.parametrize("bounded", [False, True])
def test_unsettled_raking_is_told(spark, caplog, bounded):
    docs = corpus(spark, 500)
    assert not op.fit(docs, op.Targets(bounded=bounded), cycles=1).settled
    assert any("didn't settle in 1 cycles" in r.getMessage() for r in caplog.records)
    assert op.fit(docs, op.Targets(bounded=bounded)).settled


@pytest.mark.parametrize("n", [9_000, 11_000])
def test_one_rule_at_every_number_of_sources(spark, monkeypatch, n):
    """The way by jobs takes as many cycles as the way on the driver, and ends with the same probabilities. Languages and
    topics go together, so that raking takes more than sixty cycles."""
    r = np.random.default_rng(1)
    t = op.Targets(budget=0.5, bounded=True, languages={"en": 0.51, op.REST: 0.49}, topics={"legal": 0.49, "prose": 0.51}, signs={"legal": ("x",)})
    rows = []
    for k in range(n):
        most = k % 2
        rows += [(f"s{k}", cell, int(1 + 1000 * share * (0.5 + r.random()))) for cell, share in enumerate((0.85 if most else 0.1, 0.03, 0.03, 0.1 if most else 0.85))]
    celled, seen, cycles = spark.createDataFrame(rows, "source_key string, cell int, tokens long").coalesce(2), [], []
    true = op._source_factor
    for few in (20_000, 100):
        monkeypatch.setattr(op, "FEW", few)
        made = []
        monkeypatch.setattr(op, "_source_factor", lambda f, made=made: made.append(0) or true(f))
        mix = op.fit_cells(celled, t)
        assert mix.settled
        cycles.append(len(made))
        seen.append(celled.join(mix.sources, "source_key").select("source_key", "cell", mix.probability().alias("p")).toPandas().set_index(["source_key", "cell"])["p"].sort_index())
    assert np.abs(seen[0] - seen[1]).max() < 1e-6
    assert cycles[1] > 2 * 60  # two jobs a cycle


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_default_targets_are_met_as_far_as_the_tables_allow(spark, sf):
    got = op.op1_mixing(spark, f"/root/testdata/{sf}").toPandas()
    assert (abs(got["topic_wanted"] - got["topic_reached"]) < 0.01).all()
    assert (abs(got["language_wanted"] - got["language_reached"]) < 0.01).all()
