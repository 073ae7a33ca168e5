from __future__ import annotations

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest

from strataframe.llm import jpeg as op


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def test_query_returns_what_was_stored(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op.op8_jpeg(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        p = padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(docs[r["doc_id"]].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_any_bytes_come_back():
    r = np.random.default_rng(0)
    payloads = [r.integers(0, 256, 64 * n, np.uint8) for n in (1, 2, 9, 300)] + [np.full(640, v, np.uint8) for v in (0, 255, 128)] + [np.tile(np.array([0, 255], np.uint8), 640)]
    media = op.encode_payloads(payloads)
    thumbs = list(op.decode_thumbnails([x for m in media for x in m]))
    assert [t.tobytes() for t in thumbs] == [p.tobytes() for p in payloads]


def test_long_payloads_go_on_in_further_images(monkeypatch):
    monkeypatch.setattr(op, "MOST_ROWS", 3)
    p = np.arange(64 * 8, dtype=np.uint64).astype(np.uint8)
    (images,) = op.encode_payloads([p])
    assert len(images) == 3 and list(op.split(b"".join(images))) == images
    assert b"".join(t.tobytes() for t in op.decode_thumbnails(images)) == p.tobytes()


def _bits(pairs):
    text = "".join(f"{c:0{n}b}" for c, n in pairs)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def _image(blocks, wide, high, components, interval=0):
    """blocks: (component, DC difference, AC as (run, value)) in scan order; table 0 of the writer and an AC table of all small codes."""
    ac_values = [0x00, 0x01, 0x11, 0x02, 0xF0, 0x21, 0x12, 0x31]
    ac_lengths = [0, 0, 0, 8] + [0] * 12
    dc = {v: (c, n) for v, c, n in op._codes(op.DC_LENGTHS, op.DC_VALUES)}
    ac = {v: (c, n) for v, c, n in op._codes(ac_lengths, ac_values)}

    def number(v, size):
        return (v if v > 0 else v + (1 << size) - 1, size)

    parts, out = [], b""
    per = interval * sum(h * v for _, h, v, _ in components) if interval else len(blocks)
    for k, (_, d, acs) in enumerate(blocks):
        size = abs(d).bit_length()
        parts.append(dc[size])
        if size:
            parts.append(number(d, size))
        for run, v in acs:
            size = abs(v).bit_length()
            parts.append(ac[run << 4 | size])
            if size:
                parts.append(number(v, size))
        parts.append(ac[0])
        if (k + 1) % per == 0 and k + 1 < len(blocks):
            out += _bits(parts) + bytes((0xFF, 0xD0 + ((k + 1) // per - 1) % 8))
            parts = []
    out += _bits(parts)
    seg = lambda m, b: bytes((0xFF, m)) + (len(b) + 2).to_bytes(2, "big") + b
    frame = bytes((8,)) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes((len(components),)) + b"".join(bytes((c, h << 4 | v, q)) for c, h, v, q in components)
    scan = bytes((len(components),)) + b"".join(bytes((c, 0)) for c, *_ in components) + bytes((0, 63, 0))
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\x00" + bytes([16]) * 64) + seg(0xC0, frame) + seg(0xC4, b"\x00" + bytes((*op.DC_LENGTHS, *op.DC_VALUES))) + seg(0xC4, b"\x10" + bytes((*ac_lengths, *ac_values)))
    return head + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"") + seg(0xDA, scan) + out + b"\xff\xd9"


def test_grey_image_with_ac_and_restarts():
    diffs = [3, -5, 0, 7, 1, -9]
    blocks = [(0, d, [(0, 1), (1, -1), (15, 0), (2, 1)] if k % 2 else []) for k, d in enumerate(diffs)]
    whole = _image(blocks, 24, 16, [(1, 1, 1, 0)])
    (thumb,) = op.decode_thumbnails([whole])
    assert thumb.tolist() == (np.cumsum(diffs).reshape(2, 3) * 2 + 128).tolist()
    (again,) = op.decode_thumbnails([_image(blocks, 24, 16, [(1, 1, 1, 0)], interval=3)])
    assert again.tolist() == np.concatenate([np.cumsum(diffs[:3]), np.cumsum(diffs[3:])]).reshape(2, 3).__mul__(2).__add__(128).tolist()


def test_colour_image_with_subsampling():
    """Two MCUs of 2x2 luminance blocks and one block each of the other components."""
    y = [1, 2, 3, 4, 5, 6, 7, 8]
    blocks, last = [], 0
    for mcu in range(2):
        for v in y[4 * mcu : 4 * mcu + 4]:
            blocks.append((0, v - last, []))
            last = v
        blocks += [(1, 9, [(0, 1)]), (2, -9, [])]
    (thumb,) = op.decode_thumbnails([_image(blocks, 30, 12, [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)])])
    assert thumb.tolist() == (np.array([[1, 2, 5, 6], [3, 4, 7, 8]]) * 2 + 128).tolist()


@pytest.mark.parametrize("media", [b"", b"\xff", b"GIF89a", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", op.encode_payloads([np.zeros(64, np.uint8)])[0][0][:-20]])
def test_broken_media_give_nulls(spark, media):
    good = op.encode_payloads([np.arange(64, dtype=np.uint8)])[0][0]
    df = spark.createDataFrame([(1, media), (2, good), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in op.read_media(df).collect()}
    assert got[1]["payload"] is None and got[3]["feature"] is None
    assert bytes(got[2]["payload"]) == bytes(range(64)) and (got[2]["width"], got[2]["height"]) == (512, 8)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    stored = op.store_texts(odd_documents)
    got = op.read_media(stored, ("doc_id", "n_bytes", "media")).collect()
    assert sorted((repr(r["doc_id"]), bytes(r["payload"])) for r in got) == sorted((repr(r["doc_id"]), padded(r["text"])) for r in rows)
    assert len({bytes(r["media"]) for r in got if r["doc_id"] in (6, 7)}) == 1
    assert op.store_texts(no_documents).count() == 0


def test_memory_of_a_long_text(spark):
    """Images are coded and decoded some at a time."""
    p = np.random.default_rng(1).integers(0, 256, 12 << 20, np.uint8)
    tracemalloc.start()
    try:
        (images,) = op.encode_payloads([p])
        size = 0
        for t in op.decode_thumbnails(iter(images)):
            size += t.size
        assert size == len(p) and tracemalloc.get_traced_memory()[1] < 130 << 20
    finally:
        tracemalloc.stop()
