from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import sentencepieces as op

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE = op.ChunkTable(PATH)


def encoded(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return [(n, i, d) for _, ns, ids, decoded in op.encoded(batch, "text", TABLE) for n, i, d in zip(ns, ids, decoded, strict=True)]


bits = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "word", "Ünï", "▁", "日本", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>", "a", ".", " ", "　", "\x00", "①", "é"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(bits, st.text(max_size=12)), min_size=1, max_size=5))
def test_equals_library(texts):
    for (n, ids, decoded), text in zip(encoded(texts), texts, strict=True):
        want = SP.encode(text)
        assert (n, ids.decode(), decoded.decode()) == (len(want), ",".join(map(str, want)), SP.decode(want))


def test_query_equals_library(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op.op7_sentencepiece(spark, sf_dir).collect():
        ids = SP.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(op, "TABLE_WORDS", 3)
    texts = [f"some words {k} and more {k * k}" for k in range(40)]
    assert [i.decode() for _, i, _ in encoded(texts)] == [",".join(map(str, SP.encode(t))) for t in texts]


def test_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    got = op.encode_decode(odd_documents, PATH, carry=("doc_id", "text"), real=True).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [tuple(r) for r in rows]
    for r in got:
        ids = SP.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (SP.decode(ids) if ids else "")
    assert op.encode_decode(no_documents, PATH).count() == 0
