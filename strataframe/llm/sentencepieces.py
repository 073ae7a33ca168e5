"""SentencePiece encoding and decoding by a distinct-chunk table.

If no piece of the vocabulary holds a whitespace marker after another character, no merge
can cross from a word into the next marker. So a text falls into marked words, each a run of
markers and the characters up to the next run, that the model segments independently. A marker that
is written in a text counts as the space that it stands for. A task
collects the distinct marked words of a slice of texts, segments each once, and joins ids and
decoded text back by position through the dictionary's indices.

The table belongs to a task, not to the corpus: joining a corpus-wide table back by position
would shuffle every word of every text (several times the input), where a task's own table
moves nothing and is bounded (TABLE_WORDS).

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty
text; very long texts are encoded whole, one in memory at a time; rows are kept one for one, repeated rows and null doc_id included; other columns pass
by name only where asked for (carry).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import mapped, slices, table

#: Marked words that a task keeps between slices; the table starts anew beyond it.
TABLE_WORDS = 250_000
MARK = "▁"


class ChunkTable:
    """Ids (as text "1,2,"), their number and the decoded bytes of distinct marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        self.splits = all(MARK not in p.lstrip(MARK) for p in pieces)
        #: The table needs plain text before the segmentation: nothing but the marker changes.
        self.splits &= sp.normalize("A  bÉ① ") == f"{MARK}A{MARK}{MARK}bÉ①{MARK}"
        #: A marker that is written in a text reads as a space does.
        self.splits &= sp.normalize(f"{MARK}a{MARK}{MARK} b{MARK}") == sp.normalize(" a   b ")
        self.lone = [sp.piece_to_id(MARK)]
        self.before = sp.encode("a")
        self.skip = len(sp.decode(self.before))
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}

    def entries(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """words: without the marker that each has before it."""
        if len(self.known) > TABLE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ids = self.sp.encode([w.decode() for w in new], num_threads=1)
            ids = [x if w else self.lone for w, x in zip(new, ids, strict=True)]
            texts = self.sp.decode([self.before + x for x in ids], num_threads=1)
            for w, x, t in zip(new, ids, texts, strict=True):
                known[w] = len(x), b"".join(b"%d," % i for i in x), t[self.skip :].encode()
        return [known[w] for w in words]


def _marked(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the marked words of the texts begin, and the first word of each text."""
    n = len(data)
    space = data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[rows[:-1][rows[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, rows)


def _spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in place of each marker that is written in them."""
    a, b, c = MARK.encode()
    hit = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
    data = data.copy()
    data[hit] = 0x20
    keep = np.ones(len(data), bool)
    keep[hit + 1] = keep[hit + 2] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def encoded(batch: pa.RecordBatch, text: str, chunks: ChunkTable) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes], list[bytes]]]:
    """For slices of a batch: per row the number of ids, the ids as "1,2,3", the decoded UTF-8."""
    for part, data, rows in slices(batch, text):
        texts = data.tobytes()
        if chunks.splits and MARK.encode() in texts:
            data, rows = _spaced(data, rows)
        if not chunks.splits:  # a model that the table doesn't fit
            whole = [texts[a:b].decode() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            ids = chunks.sp.encode(whole, num_threads=1)
            yield part, [len(x) for x in ids], [",".join(map(str, x)).encode() for x in ids], [chunks.sp.decode(x).encode() if x else b"" for x in ids]
            continue
        starts, first = _marked(data, rows)
        if not len(starts):
            yield part, [0] * part.num_rows, [b""] * part.num_rows, [b""] * part.num_rows
            continue
        # the first word of a text has its marker added, the others bring theirs: drop that byte
        own = np.ones(len(starts), bool)
        own[first[:-1][first[:-1] < first[1:]]] = False
        keep = np.ones(len(data), bool)
        keep[starts[own]] = False
        ends = np.append(starts[1:], len(data))
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts - own, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])]).dictionary_encode()
        index = words.indices
        got = chunks.entries(words.dictionary.to_pylist())
        counts = np.concatenate([[0], np.cumsum(np.array([x[0] for x in got], np.int64)[index.to_numpy()])])
        sides = []
        for k in (1, 2):
            _, at, side = pa.array([x[k] for x in got], pa.large_binary()).take(index).buffers()
            sides.append((np.frombuffer(at, np.int64)[: len(index) + 1], memoryview(side)))
        (at_ids, ids), (at_text, decoded) = sides
        n, out_ids, out_text = [], [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n.append(int(counts[b] - counts[a]))
            out_ids.append(bytes(ids[at_ids[a] : at_ids[b] - 1]) if a < b else b"")
            if a < b:
                head = chunks.sp.decode([int(x) for x in bytes(ids[at_ids[a] : at_ids[a + 1] - 1]).split(b",")]).encode()
                out_text.append(head + bytes(decoded[at_text[a + 1] : at_text[b]]))
            else:
                out_text.append(b"")
        yield part, n, out_ids, out_text


def _id_lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [x.count(b",") + 1 if x else 0 for x in ids]).astype(np.int32)
    flat = np.array(b",".join(x for x in ids if x).split(b",") if offsets[-1] else [], dtype="S").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode_decode(docs: DataFrame, model: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), real: bool = False) -> DataFrame:
    """Encodes and decodes whole texts; one row per row of docs.

    model: path of a sentencepiece model that every executor can read. Returns the columns
    named in carry, n_tokens and either the digests (ids_sha256, decoded_sha256) or, with
    real, the ids as array<int> and the decoded text.
    """
    kept = docs.select(*carry, *[text][text in carry :])
    schema = docs.select(*carry).schema.add("n_tokens", "long")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string") if real else schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model)
        for batch in batches:
            for part, n, ids, decoded in encoded(batch, text, chunks):
                if real:
                    made = [_id_lists(ids), pa.array([x.decode() for x in decoded], pa.string())]
                else:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(n, pa.int64()), *made], names=schema.names)

    return mapped(kept, run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
