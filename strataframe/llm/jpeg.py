"""Baseline JPEG as a media column: decoding to DC-only luminance thumbnails, and writing bytes so.

The decoder reads markers (DQT, SOF0, DHT, DRI, SOS, RST, EOI), Huffman-decodes the scan and
keeps the DC coefficient of each 8x8 block of the first component: dequantised and level
shifted, it is the block's mean, one pixel of a thumbnail an eighth as wide and high. Restart
intervals don't depend on each other, so all intervals of all images of a slice with the same
tables are decoded together, a step of numpy for each symbol.

A payload is stored losslessly as such an image: 64 blocks a row, each block's mean one
byte, a restart interval for each row of blocks. A text too long for one image (8191 rows)
goes on in further images, one behind the other. Images are coded and decoded some at a time, so a
long text takes a few times its own size and no more.

Defined results: null text counts as empty (64 bytes 0); equal texts have equal values; rows
are kept one for one, repeated rows and null doc_id included. Media that isn't baseline JPEG
(no SOI, no frame, progressive, arithmetic, 12 bit, broken scan) raises ValueError in
decode_thumbnails() and gives nulls in the column operator, as does a null media column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mapped, slices, table

WIDE = 64
#: Rows of blocks of one image at most: 8 * 8191 lines.
MOST_ROWS = 8191

# The format's usual Huffman table for luminance DC (codes of each length; categories).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: AC table of the writer: one code, end of block.
AC_LENGTHS = (1,) + (0,) * 15
AC_VALUES = (0,)


def _codes(lengths, values) -> list[tuple[int, int, int]]:
    """(value, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((values[k], code, size))
            code += 1
            k += 1
        code <<= 1
    return out


def _lookup(lengths, values) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol and its code's length (0: no code)."""
    symbol, size = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for value, code, n in _codes(lengths, values):
        symbol[code << 16 - n : code + 1 << 16 - n] = value
        size[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, size


@dataclass
class Component:
    key: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    interval: int = 0
    scan: int = 0
    end: int = 0


def parse(data: bytes, at: int = 0) -> Frame:
    """The markers of the image that begins at a place, up to its scan; end is after its EOI."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    f, at = Frame(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                f.quants[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                f.tables[body[0]] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            f.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not f.components or not f.width or not f.height or body[0] != len(f.components):
                raise ValueError("no frame, or a scan of some components only")
            for k, c in enumerate(f.components):
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            f.scan = at + 2 + size
            break
        at += 2 + size
    at = f.scan
    while True:  # to the marker that isn't a restart
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no EOI marker")
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
            continue
        f.end = at + 2
        return f


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes without stuffing and restart markers, and where each interval begins in them."""
    mark = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
    after = data[mark + 1]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[mark[after == 0] + 1] = False
    keep[restart] = False
    keep[restart + 1] = False
    place = np.cumsum(keep) - keep
    return data[keep], np.concatenate([[0], place[restart]])


class _Bits:
    def __init__(self, data: np.ndarray):
        x = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.words = x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits at bit positions."""
        return (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.int64)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _flat_table(tables: dict, dc: int, ac: int) -> tuple[np.ndarray, np.ndarray]:
    """By 16 bits: the DC difference of a block without AC, and the bits of code, difference and
    end of block; 0 bits where they don't fit or the block has more."""
    (symbol, size), (ac_symbol, ac_size) = _lookup(*tables[dc]), _lookup(*tables[16 | ac])
    x = np.arange(65536)
    used = size + symbol
    fits = (size > 0) & (used < 16) & (symbol <= 11)
    used_in, category = np.where(fits, used, 0), np.where(fits, symbol, 0)
    rest = x << used_in & 0xFFFF
    end = fits & (ac_size[rest] > 0) & (ac_symbol[rest] == 0) & (used_in + ac_size[rest] <= 16)
    difference = _extended(x >> np.maximum(16 - used_in, 0) & (1 << category) - 1, category)
    return np.where(end, difference, 0), np.where(end, used_in + ac_size[rest], 0)


def _decode_scans(data: np.ndarray, begins: np.ndarray, blocks: np.ndarray, pattern: list[Component], tables: dict) -> np.ndarray:
    """DC values of the pattern's blocks, in order, interval by interval.

    blocks: how many blocks each interval has, in whole patterns (MCUs).
    """
    bits, at = _Bits(data), begins * 8
    most = len(bits.words) * 8 - 32
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]), np.int64)
    flat = {(c.dc, c.ac): _flat_table(tables, c.dc, c.ac) for c in pattern}
    full = {key: _lookup(*t) for key, t in tables.items()}
    carry = {c.key: np.zeros(len(begins), np.int64) for c in pattern}
    order = np.argsort(-blocks, kind="stable")  # the longest first, so that those at work are a prefix
    at, first, sizes = at[order], first[:-1][order], blocks[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        c = pattern[step % len(pattern)]
        n = int(np.searchsorted(-sizes, -step, "left"))
        if (at[:n] > most).any():
            raise ValueError("the scan ends early")
        x = bits.peek(at[:n])
        difference, used = flat[c.dc, c.ac]
        difference, used = difference[x], used[x]
        hard = np.flatnonzero(used == 0)
        if len(hard):
            difference[hard], used[hard] = _hard_block(bits, at[hard], full[c.dc], full[16 | c.ac], most)
        carry[c.key][:n] += difference
        out[first[:n] + step] = carry[c.key][:n]
        at[:n] += used
    return out


def _hard_block(bits: _Bits, at: np.ndarray, dc, ac, most: int) -> tuple[np.ndarray, np.ndarray]:
    """DC differences of blocks that have AC coefficients, and all their bits."""
    x, pos = bits.peek(at), at.copy()
    category, size = dc[0][x], dc[1][x]
    if (size == 0).any() or (category > 11).any():
        raise ValueError("no such DC code")
    pos += size
    difference = _extended(bits.peek(pos) >> 16 - category, category)
    pos += category
    k, left = np.ones(len(at), np.int64), np.arange(len(at))
    while len(left):
        if (pos[left] > most + 16).any():
            raise ValueError("the scan ends early")
        x = bits.peek(pos[left])
        symbol, size = ac[0][x], ac[1][x]
        if (size == 0).any():
            raise ValueError("no such AC code")
        pos[left] += size + (symbol & 15)
        k[left] += (symbol >> 4) + 1
        left = left[(symbol != 0) & (k[left] < 64)]
    return difference, pos - at


def decode_thumbnails(images: Iterable[bytes]) -> Iterator[np.ndarray]:
    """DC-only luminance thumbnails (uint8, one pixel for each 8x8 block) of baseline JPEGs, some
    SLICE_BYTES of them decoded together."""
    some, size = [], 0
    for image in images:
        if some and size + len(image) > SLICE_BYTES:
            yield from _decoded(some)
            some, size = [], 0
        some.append(image)
        size += len(image)
    yield from _decoded(some)


def _decoded(images: list[bytes]) -> list[np.ndarray]:
    frames = [parse(x) for x in images]
    out: list[np.ndarray] = [None] * len(images)
    alike: dict = {}
    for k, f in enumerate(frames):
        alike.setdefault((tuple(sorted(f.tables.items())), tuple((c.key, c.across, c.down, c.dc, c.ac) for c in f.components)), []).append(k)
    for (tables, _), group in alike.items():
        parts, begins, blocks, shapes, base = [], [], [], [], 0
        pattern = frames[group[0]].components
        lone = len(pattern) == 1
        mcu = [c for c in pattern for _ in range(1 if lone else c.across * c.down)]
        for k in group:
            f = frames[k]
            h, v = (1, 1) if lone else (max(c.across for c in pattern), max(c.down for c in pattern))
            across, down = -(-f.width // (8 * h)), -(-f.height // (8 * v))
            total = across * down
            per = f.interval or total
            data, starts = _intervals(np.frombuffer(images[k], np.uint8)[f.scan : f.end - 2])
            if len(starts) != -(-total // per):
                raise ValueError("restart intervals are missing")
            parts += data, np.full(8, 255, np.uint8)
            begins.append(starts + base)
            base += len(data) + 8
            n = np.full(len(starts), per)
            n[-1] = total - per * (len(starts) - 1)
            blocks.append(n * len(mcu))
            shapes.append((across, down, total))
        dc = _decode_scans(np.concatenate(parts), np.concatenate(begins), np.concatenate(blocks), mcu, dict(tables))
        at = 0
        for k, (across, down, total) in zip(group, shapes, strict=True):
            f, c = frames[k], pattern[0]
            if c.quant not in f.quants:
                raise ValueError("no quantisation table")
            mine = dc[at : at + total * len(mcu)].reshape(down, across, len(mcu))
            at += total * len(mcu)
            h, v = (1, 1) if lone else (c.across, c.down)
            luma = mine[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            # the first component's own size in blocks
            most = (1, 1) if lone else (max(x.across for x in pattern), max(x.down for x in pattern))
            wide, high = -(-f.width * h // (8 * most[0])), -(-f.height * v // (8 * most[1]))
            mean = np.rint(luma[:high, :wide] * frames[k].quants[c.quant] / 8) + 128
            out[k] = np.clip(mean, 0, 255).astype(np.uint8)
    return out


def _writer_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255: DC code, difference, end of block."""
    code = {value: (c, n) for value, c, n in _codes(DC_LENGTHS, DC_VALUES)}
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        c, n = code[category]
        low = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255], size[d + 255] = (c << category | low) << 1, n + category + 1
    return bits, size


_BITS, _SIZE = _writer_codes()


def _header(rows: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body

    return (
        b"\xff\xd8"
        + segment(0xDB, bytes((0,)) + bytes((8,)) * 64)
        + segment(0xC0, bytes((8,)) + (8 * rows).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big") + bytes((1, 1, 0x11, 0)))
        + segment(0xC4, bytes((0x00, *DC_LENGTHS, *DC_VALUES)))
        + segment(0xC4, bytes((0x10, *AC_LENGTHS, *AC_VALUES)))
        + segment(0xDD, WIDE.to_bytes(2, "big"))
        + segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0)))
    )


def encode_rows(pixels: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """One JPEG for each run of rows of a matrix of 64 columns whose blocks' means are its values."""
    n = len(pixels)
    difference = np.diff(pixels.astype(np.int64), axis=1, prepend=128) + 255
    bits, size = _BITS[difference], _SIZE[difference]
    for _ in range(2):  # four codes of 16 bits at most go into one of 64
        bits = bits[:, ::2] << size[:, 1::2].astype(np.uint64) | bits[:, 1::2]
        size = size[:, ::2] + size[:, 1::2]
    ends = np.cumsum(size, axis=1)
    stride = WIDE * 16 // 64 + 1
    total = ends[:, -1]
    begin = ends - size
    word = begin >> 6
    room = 64 - (begin & 63) - size  # bits left in the word after this code; under 0: it goes on in the next
    over = np.maximum(-room, 0).astype(np.uint64)
    high = np.where(room >= 0, bits << np.maximum(room, 0).astype(np.uint64), bits >> over)
    low = np.where(room < 0, bits << (np.uint64(64) - np.maximum(over, 1)), 0)
    at = (np.arange(n)[:, None] * stride + word).ravel()
    words = np.zeros(n * stride + 1, np.uint64)
    for where, what in ((at, high.ravel()), (at + 1, low.ravel())):
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        words[where[new]] |= np.bitwise_or.reduceat(what, new)
    coded = words[:-1].reshape(n, stride).astype(">u8").view(np.uint8).reshape(n, stride * 8)
    length = (total + 7) >> 3
    coded[np.arange(n), length - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)  # the last byte is filled with 1
    flat = coded[np.arange(stride * 8) < length[:, None]]
    stuffed = flat == 0xFF
    row_end = np.cumsum(length)
    last = np.zeros(n, bool)
    last[np.cumsum(rows) - 1] = True
    shift = np.cumsum(stuffed) - stuffed
    marks = np.concatenate([[0], np.cumsum(np.where(last, 0, 2))])[:-1]
    place = np.arange(len(flat)) + shift + np.repeat(marks, length)
    out = np.zeros(len(flat) + int(stuffed.sum()) + int(2 * (~last).sum()), np.uint8)
    out[place] = flat
    row_out = place[row_end - 1] + 1 + stuffed[row_end - 1]  # after each row's bytes
    within = np.arange(n) - np.repeat(np.cumsum(rows) - rows, rows)
    out[row_out[~last]] = 0xFF
    out[row_out[~last] + 1] = 0xD0 + (within[~last] & 7)
    made, a = [], 0
    for k, b in zip(rows.tolist(), row_out[last].tolist(), strict=True):
        made.append(_header(k) + out[a:b].tobytes() + b"\xff\xd9")
        a = b
    return made


def encode_payloads(payloads: list[np.ndarray]) -> list[list[bytes]]:
    """Each payload (bytes, a positive multiple of 64) as one or more JPEGs. Rows of one image at most
    are coded together."""
    out: list[list[bytes]] = [[] for _ in payloads]
    some, rows = [], 0

    def code() -> None:
        pixels = np.concatenate([payloads[k][a:b] for k, a, b in some]).reshape(-1, WIDE)
        for (k, _, _), image in zip(some, encode_rows(pixels, np.array([(b - a) // WIDE for _, a, b in some])), strict=True):
            out[k].append(image)

    for k, p in enumerate(payloads):
        for a in range(0, len(p), MOST_ROWS * WIDE):
            b = min(a + MOST_ROWS * WIDE, len(p))
            if some and rows + (b - a) // WIDE > MOST_ROWS:
                code()
                some, rows = [], 0
            some.append((k, a, b))
            rows += (b - a) // WIDE
    if some:
        code()
    return out


def split(media: bytes) -> Iterator[bytes]:
    """The JPEGs that stand one behind the other."""
    at = 0
    while at < len(media):
        end = parse(media, at).end
        yield media[at:end]
        at = end


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8x8 cells is darker than the next to its right, of nine across."""
    h, w = thumb.shape
    rows, cols = np.arange(8) * h // 8, np.arange(9) * w // 9
    cells = thumb[rows][:, cols].astype(np.int64)
    return f"{int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), 'big'):016x}"


def described(thumbs: list[np.ndarray]) -> str:
    """Dimensions of the first thumbnail's image, the number of images, and hashes of the thumbnails."""
    h, w = thumbs[0].shape
    crc = 0
    for t in thumbs:
        crc = zlib.crc32(t.tobytes(), crc)
    return f"{8 * w}x{8 * h}:{len(thumbs)}:{crc:08x}:{difference_hash(thumbs[0])}"


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8, padded to a positive multiple of 64, as JPEGs."""
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, text):
                sizes = np.diff(rows)
                padded = np.maximum(64, -(-sizes // 64) * 64)
                payloads = [np.concatenate([data[a:b], np.zeros(p - (b - a), np.uint8)]) for a, b, p in zip(rows[:-1], rows[1:], padded, strict=True)]
                media = [b"".join(x) for x in encode_payloads(payloads)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(media, pa.binary())], names=schema.names)

    return mapped(docs.select("doc_id", text), run, schema)


def read_media(media: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and, from the stored bytes of column media: width, height, n_images, payload (the
    thumbnails' pixels), feature; null where the media is null or not baseline JPEG."""
    schema = media.select(*carry).schema.add("width", "long").add("height", "long").add("n_images", "long").add("payload", "binary").add("feature", "string")

    def told(thumbs: list[np.ndarray] | None) -> tuple:
        if not thumbs:
            return (None,) * 5
        return 8 * thumbs[0].shape[1], 8 * thumbs[0].shape[0], len(thumbs), b"".join(t.tobytes() for t in thumbs), described(thumbs)

    def decoded(items: list[bytes | None]) -> list[tuple]:
        try:
            owners: list[int] = []

            def images() -> Iterator[bytes]:
                for k, x in enumerate(items):
                    for image in split(x or b""):
                        owners.append(k)
                        yield image

            thumbs: list[list[np.ndarray]] = [[] for _ in items]
            for n, thumb in enumerate(decode_thumbnails(images())):
                thumbs[owners[n]].append(thumb)
            return [told(x) for x in thumbs]
        except (ValueError, IndexError, KeyError):
            if len(items) == 1:
                return [told(None)]
            return [y for x in items for y in decoded([x])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column("media"), 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size < SLICE_BYTES):
                    size += len(column[to].as_buffer() or b"") if column[to].is_valid else 0
                    to += 1
                part = batch.slice(at, to - at)
                wide, high, n, payload, feature = zip(*decoded(part.column("media").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(wide, pa.int64()), pa.array(high, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(feature, pa.string())], names=schema.names)
                at = to

    return mapped(media.select(*carry, *["media"]["media" in carry :]), run, schema)


def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = read_media(stored, ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "n_images",
    )
