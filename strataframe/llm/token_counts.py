"""Token counts by overlap resynchronisation.

A huge text is cut into overlapping chunks that are encoded wherever there is room, each with
the offsets of its tokens. Neighbours are spliced at a position of their overlap where both
have the same token beginning right after ASCII whitespace: the tokenizer's pre-tokens never
hold whitespace and its normaliser composes nothing across it, so what follows such a place
doesn't depend on what came before. If two neighbours share no such place, the overlap of
that text is widened fourfold, at last to the whole text, which then is one chunk.

Texts below that length are cut at every such place: the words between ASCII whitespace
are encoded once for each task's table and their counts summed. Texts that repeat are cut and encoded
once; what is cut is read from a table of the different long texts, also where overlaps widen.

Whether a tokenizer parts texts at whitespace is read from its file (tells_of_blanks()) and tried at the start
(parts_at_blanks()); one that doesn't encodes whole texts.

Defined results: null text counts as empty and has 0 tokens; one row per row of docs, repeated
rows and null doc_id included; columns other than doc_id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, made_folders
from .common import Words, mapped, materialize, slices, table

#: Longer texts (code points) are cut into chunks.
LONG = 32_768
CHUNK = 16_384
OVERLAP = 256
LIMIT = 2_048
#: Words whose counts a task keeps between slices.
TABLE_WORDS = 400_000
BLANK = frozenset(" \t\n\v\f\r")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Words of letters, digits, marks, contractions and other scripts that are tried beside each other.
_PROBES = ("hello", "a", "I", "42", "it's", "'s", "é", "e\u0301", "\u0301", "日本", "ﬁ", "…", "--", "x_y", "<|endoftext|>", "\u00a0", "\U0001f600")


#: Kinds of normalisers and pre-tokenizers that join nothing across whitespace, whatever they are set to.
_SAFE = frozenset("NFC NFD NFKC NFKD Lowercase StripAccents Sequence BertNormalizer ByteLevel Whitespace WhitespaceSplit BertPreTokenizer Punctuation Digits".split())


def tells_of_blanks(path: str) -> list[str]:
    """Why a tokenizer, by its file, might hold whitespace in a token: added tokens or entries of the vocabulary with
    whitespace or that take it from beside them, and parts of its normaliser or pre-tokenizer that aren't known to
    part or keep it. What is left is tried by parts_at_blanks()."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    out = [f"added token {t['content']!r}" for t in told.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c in BLANK or c == "\u2581" for c in t["content"])]
    vocabulary = told["model"].get("vocab") or {}
    names = vocabulary if isinstance(vocabulary, dict) else [v[0] for v in vocabulary]
    out += [f"entry {w!r}" for w in names if not BLANK.isdisjoint(w)][:9]

    def parts(x):
        if isinstance(x, dict):
            yield x
            for more in x.get("normalizers") or x.get("pretokenizers") or []:
                yield from parts(more)

    for part in (p for name in ("normalizer", "pre_tokenizer") for p in parts(told.get(name))):
        kind, pattern = part["type"], (part.get("pattern") or {})
        if kind == "Replace" and part.get("content") == " " and pattern.get("Regex") == r"\s+":
            continue  # runs of whitespace become one space
        if kind == "Split" and part.get("behavior") == "Removed" and part.get("invert"):
            continue  # only what the pattern finds is kept; whether it finds whitespace is tried
        if kind not in _SAFE:
            out.append(f"{kind} {pattern or ''}".strip())
    if not told.get("pre_tokenizer"):
        out.append("no pre-tokenizer")
    return out


def parts_at_blanks(path: str) -> bool:
    """Whether the tokens of two words with ASCII whitespace between are those of each word."""
    if tells_of_blanks(path):
        return False
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer = _tokenizer(path)
    own = {w: encode(w) for w in _PROBES}
    gaps = [*sorted(BLANK), "  ", "\r\n", " \t "]
    return all(encode(a + gap + b) == own[a] + own[b] for gap in gaps for a in _PROBES for b in _PROBES) and all(encode(gap + a + gap) == own[a] for gap in gaps for a in _PROBES)


def _whole(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            n = [len(tokenizer.encode(t.as_py(), add_special_tokens=False)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=names)

    return run


def _short(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            for part, data, rows in slices(batch, "text"):
                words = Words(data, rows)
                distinct, index = words.coded()
                distinct = distinct.to_pylist()
                if len(known) > TABLE_WORDS:
                    known.clear()
                new = [w for w in distinct if w not in known]
                for at in range(0, len(new), 10_000):
                    some = new[at : at + 10_000]
                    for w, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = len(e)
                counts = np.zeros(len(index) + 1, np.int64)
                np.cumsum(np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[index], out=counts[1:])
                n = counts[words.first[1:]] - counts[words.first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n)], names=names)

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            keys, at, starts, last, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at, pa.int64()), pa.array(starts, pa.int64()), pa.array(last), pa.array(texts)], names=["key", "i", "start", "is_last", "chunk"])

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                text, rows = text.as_py(), []
                starts = range(0, max(1, len(text) - overlap), chunk - overlap)
                for i, s in enumerate(starts):
                    rows.append((key.as_py(), i, s, i == len(starts) - 1, text[s : s + chunk]))
                    if len(rows) == 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return run


def _encode(path: str, overlap: int):
    """Per chunk: the number of tokens; for head and tail, the shared places as
    position << 20 | token id, with the number of the chunk's tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            made = []
            for start, last, text in zip(batch.column("start").to_pylist(), batch.column("is_last").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                e = tokenizer.encode(text, add_special_tokens=False)
                ids, size = e.ids, len(text)
                head, tail = ([], []), ([], [])
                for k, (a, _) in enumerate(e.offsets):
                    if a and text[a - 1] in BLANK:
                        if start and a < overlap:
                            head[0].append((start + a) << 20 | ids[k])
                            head[1].append(k)
                        if not last and a >= size - overlap:
                            tail[0].append((start + a) << 20 | ids[k])
                            tail[1].append(k)
                made.append((len(ids), *head, *tail))
            n, hp, hk, tp, tk = zip(*made, strict=True)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), batch.column("is_last"), pa.array(n, pa.int64()), pa.array(hp, longs), pa.array(hk, longs), pa.array(tp, longs), pa.array(tk, longs)], names=["key", "i", "is_last", "n", "head", "head_k", "tail", "tail_k"])

    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """key, n_tokens; null where some neighbours share no place."""
    w = Window.partitionBy("key").orderBy("i")
    place = F.array_max(F.array_intersect("tail", F.lead("head").over(w)))
    cut = chunks.withColumn("to", place).withColumn("from", F.lag("to").over(w))
    k_at = lambda side, at: F.element_at(F.col(f"{side}_k"), F.array_position(side, F.col(at)).cast("int"))
    end = F.when(F.col("is_last"), F.col("n")).when(F.col("to").isNotNull(), k_at("tail", "to"))
    begin = F.when(F.col("i") == 0, F.lit(0)).when(F.col("from").isNotNull(), k_at("head", "from"))
    part = cut.select("key", (end - begin).alias("part"))
    return part.groupBy("key").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def count_long(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts: key, text; rows of a key have one text. Returns key, n_tokens, one row a key."""
    before = made_folders()
    texts = materialize(texts.groupBy("key").agg(F.first("text").alias("text")), "long-texts")
    done, left = None, texts
    while True:
        cut = mapped(left, _cut(chunk, overlap), "key string, i long, start long, is_last boolean, chunk string")
        made = mapped(cut.repartition(F.col("key"), F.col("i")), _encode(path, overlap), "key string, i long, is_last boolean, n long, head array<long>, head_k array<long>, tail array<long>, tail_k array<long>")
        got = materialize(_spliced(made), "token-splices")
        settled = got.filter(F.col("n_tokens").isNotNull())
        done = settled if done is None else done.unionByName(settled)
        failed = got.filter(F.col("n_tokens").isNull())
        if failed.isEmpty():
            break
        left = texts.join(failed.select("key"), "key", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
    done = materialize(done, "long-counts")
    discard(texts.sparkSession, before, done)
    return done


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text).

    path: a tokenizers .json that every executor can read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.length("text") > long
    names = ["doc_id", "n_bytes", "n_tokens"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    if not parts_at_blanks(path):
        return mapped(texts, _whole(path, names), schema).withColumn("over_limit", F.col("n_tokens") > limit)
    short = mapped(texts.filter(~is_long), _short(path, names), schema)
    rest = texts.filter(is_long).withColumn("key", F.concat_ws("-", F.md5("text"), F.col("n_bytes")))
    counted = count_long(rest.select("key", "text"), path, chunk, overlap)
    rest = rest.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(rest).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
