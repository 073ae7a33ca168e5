from __future__ import annotations

import json

import public_tokenizers
import pytest

from strataframe.llm import token_counts as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    t = op._tokenizer(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_equals_library_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = op.op2_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert got.loc[docs["doc_id"], "n_tokens"].tolist() == whole(docs["text"])
    assert got.loc[docs["doc_id"], "n_bytes"].tolist() == [len(x.encode()) for x in docs["text"]]
    assert (got["over_limit"] == (got["n_tokens"] > 2048)).all()


@pytest.mark.parametrize("long,chunk,overlap", [(32_768, 16_384, 256), (40, 64, 16), (10, 24, 4)])
def test_chunks_splice_to_the_whole(spark, odd_documents, long, chunk, overlap):
    rows = odd_documents.select("doc_id", "text").collect()
    got = op.count_tokens(odd_documents, PATH, long=long, chunk=chunk, overlap=overlap).collect()
    want = sorted(((r["doc_id"], n) for r, n in zip(rows, whole([r["text"] for r in rows]), strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == want


def test_overlap_widens_where_nothing_aligns(spark):
    texts = ["x" * 5_000, "日本" * 2_000, "a<|endoftext|>b " * 300, ("ab" * 700 + " ") * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in op.count_tokens(docs, PATH, long=100, chunk=128, overlap=16).collect()}
    assert [got[k] for k in range(len(texts))] == whole(texts)


def test_no_documents(spark, no_documents):
    assert op.count_tokens(no_documents, PATH).count() == 0


def test_repeated_long_texts_are_cut_once(spark, monkeypatch):
    text = "some words of a long text " * 300
    docs = spark.createDataFrame([(k, text) for k in range(50)] + [(99, text + "x")], "doc_id long, text string")
    kept = []
    monkeypatch.setattr(op, "materialize", lambda df, label: kept.append((label, real(df, label))) or kept[-1][1])
    monkeypatch.setattr(op, "discard", lambda *x: None)
    got = {r["doc_id"]: r["n_tokens"] for r in op.count_tokens(docs, PATH, long=1_000, chunk=2_000, overlap=64).collect()}
    assert [got[0], got[99]] == whole([text, text + "x"]) and len(set(got.values()) - {got[99]}) == 1
    assert dict(kept)["long-texts"].count() == 2


real = op.materialize


def test_a_tokenizer_that_keeps_blanks_encodes_whole_texts(spark, odd_documents):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert op.parts_at_blanks(PATH) and not op.parts_at_blanks(other)
    t = op._tokenizer(other)
    want = sorted(((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_documents.collect()), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in op.count_tokens(odd_documents, other, long=100).collect()), key=repr) == want


def _changed(tmp_path, change):
    told = json.load(open(PATH, encoding="utf-8"))
    change(told)
    at = tmp_path / "changed.json"
    at.write_text(json.dumps(told), encoding="utf-8")
    return str(at)


def _token(content, **more):
    return {"id": 49408, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False} | more


@pytest.mark.parametrize("token", [_token("New York"), _token("<mask>", lstrip=True), _token("<mask>", rstrip=True), _token("in", single_word=True)])
def test_a_tokenizer_whose_added_tokens_touch_whitespace(spark, tmp_path, token):
    path = _changed(tmp_path, lambda told: told["added_tokens"].append(token))
    assert op.tells_of_blanks(path) and not op.parts_at_blanks(path)
    texts = ["in New York now", "a <mask> b", "New  York", None, "word " * 20_000 + "New York"]
    t = op._tokenizer(path)
    got = op.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    assert [r["n_tokens"] for r in got.orderBy("doc_id").collect()] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name,part", [("normalizer", {"type": "Replace", "pattern": {"String": "a b"}, "content": "c"}), ("pre_tokenizer", {"type": "Metaspace", "replacement": "\u2581", "prepend_scheme": "always", "split": False}), ("pre_tokenizer", None)])
def test_a_tokenizer_whose_file_may_join_words(tmp_path, name, part):
    path = _changed(tmp_path, lambda told: told.__setitem__(name, part))
    assert op.tells_of_blanks(path)


def test_the_given_tokenizer_parts_at_blanks():
    assert op.tells_of_blanks(PATH) == [] and op.parts_at_blanks(PATH)
    assert not op.parts_at_blanks(public_tokenizers.path("byte_bpe_50k.json"))
