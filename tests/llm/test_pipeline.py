from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from strataframe.llm import mixing, neardup, pii, quality
from test_neardup import brute


@pytest.fixture(scope="module")
def ran(spark, sf_dir):
    """What each stage was given and gave, on whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.orderBy("doc_id").collect()]
    from strataframe.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        out.append(docs.orderBy("doc_id").collect())
    return out


def test_stages_and_their_columns(ran):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "target mix", "encoding"]
    for rows in ran[1:-1]:
        assert rows[0].__fields__ == ran[0][0].__fields__


def test_quality_stage(spark, sf_dir, ran):
    kept = {r["doc_id"] for r in quality.op9_quality_rules(spark, sf_dir).filter("kept").collect()}
    assert [r["doc_id"] for r in ran[1]] == [r["doc_id"] for r in ran[0] if r["doc_id"] in kept]


def test_near_duplicate_stage(ran):
    _, parts = brute([r["text"] for r in ran[1]], corpus_pipeline.SHINGLE)
    assert ran[2] == [r for k, r in enumerate(ran[1]) if parts[k] == k]
    assert len(ran[2]) < len(ran[1])


def test_personal_data_stage(ran):
    assert [r["text"] for r in ran[3]] == [pii.redacted(r["text"]) for r in ran[2]]
    assert [r["n_chars"] for r in ran[3]] == [len(r["text"]) for r in ran[3]]
    assert any(a["text"] != b["text"] for a, b in zip(ran[2], ran[3], strict=True))


def test_mix_stage(spark, ran):
    docs = spark.createDataFrame(ran[3], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = {r["doc_id"] for r in mixing.mixed_documents(docs, corpus_pipeline.TARGETS).filter("sampled").collect()}
    assert {r["doc_id"] for r in ran[4]} == mixed
    share = sum(len(r["text"].split()) for r in ran[4]) / sum(len(r["text"].split()) for r in ran[3])
    assert abs(share - corpus_pipeline.TARGETS.budget) < 0.15


def test_encoding_stage(ran):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [r["doc_id"] for r in ran[5]] == [r["doc_id"] for r in ran[4]]
    for a, b in zip(ran[4], ran[5], strict=True):
        assert b["ids"] == sp.encode(a["text"]) and b["n_tokens"] == len(b["ids"])


def test_run_gives_the_last_stage(spark, sf_dir, ran):
    assert corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect() == ran[-1]


def test_odd_rows(spark, odd_documents, no_documents, sf_dir):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns, name
            made.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_odd_rows_by_value(spark, odd_documents, sf_dir):
    """What each stage makes of nulls, empty and long texts, repeated rows and clashing columns."""
    rows = sorted(map(tuple, odd_documents.collect()), key=repr)
    at = odd_documents.columns.index
    stages = dict(corpus_pipeline.STAGES)
    text, chars, doc = at("text"), at("n_chars"), at("doc_id")
    kept = [tuple(r) for r in stages["quality rules"](spark, odd_documents, sf_dir).collect()]
    assert all(r in rows for r in kept) and all(len(r[text].split()) >= 20 for r in kept)  # fewer words fail the base rule
    kept = sorted((tuple(r) for r in stages["near duplicates"](spark, odd_documents, sf_dir).collect()), key=repr)
    want = [(d, t) for d, t in {(r[doc], r[text]) for r in rows} if d != 7 and not (d == 1 and t.startswith("another"))]
    assert len(kept) == 9 and {r[doc] for r in kept} == {d for d, _ in want} and all(r in rows for r in kept)
    made = [tuple(r) for r in stages["personal data"](spark, odd_documents, sf_dir).collect()]
    assert len(made) == len(rows)
    for r in made:
        assert r[chars] == (None if r[text] is None else len(r[text]))
        same = [x for x in rows if x[doc] == r[doc] and x[text] == r[text]]
        assert bool(same) != (r[doc] is None)  # only the row with an address is changed
        assert r[text] is None or "a.b@c.org" not in r[text]
    kept = [tuple(r) for r in stages["target mix"](spark, odd_documents, sf_dir).collect()]
    assert all(r in rows for r in kept)
    ids = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in stages["encoding"](spark, odd_documents, sf_dir).collect()}
    assert all(n == len(found) for n, found in ids.values()) and ids[2] == ids[3] == (0, []) and ids[6] == ids[7]


def test_near_duplicates_keep_rows_that_no_other_stands_for(spark, odd_documents):
    assert {r["doc_id"] for r in neardup.keep_one(odd_documents).collect()} == {1, 2, 3, 4, 5, 6, 8, 9, None}
