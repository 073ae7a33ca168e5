"""Avro object containers as a Spark data source: spark.read.format("avro_container"), df.write.format("avro_container").

A file is a header with the schema and a 16-byte sync marker, then blocks of records with the marker behind each. A file is
read in splits: a split takes the blocks whose preceding marker begins in its bytes, so every block is
read once wherever splits are cut. A block that doesn't end in the marker, is cut short or holds more or less than its
number of records is an error. Tasks write files under temporary names; only those of tasks that Spark reports as done are
renamed, so a task that is run again adds nothing.

Types: boolean, int, bigint, float, double, string, binary, date, timestamp and timestamp_ntz (micros), and arrays, maps with
string keys and structs of them (in these without dates and times). Every field is a union with null. A nullable field that
a file lacks is null. Codecs: null and deflate. Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"Obj\x01"
#: Bytes of records in a block, of a file in a split, and rows handed to Spark at once.
BLOCK, SPLIT, ROWS = 1 << 16, 128 << 20, 8_192

# The format's names of types.
_PRIMITIVE = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
_LOGICAL = {"date": ("int", T.DateType()), "timestamp-micros": ("long", T.TimestampType()), "local-timestamp-micros": ("long", T.TimestampNTZType())}


# Schemas


def to_avro(kind: T.DataType, name: str, nested: bool = False):
    """The format's schema of a Spark type."""
    for known, of in _PRIMITIVE.items():
        if isinstance(kind, type(of)):
            return known
    for known, (stored, of) in _LOGICAL.items():
        if isinstance(kind, type(of)) and not nested:
            return {"type": stored, "logicalType": known}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", to_avro(kind.elementType, name, True)]}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": ["null", to_avro(kind.valueType, name, True)]}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", to_avro(f.dataType, f"{name}_{k}", True)]} for k, f in enumerate(kind)]}
    raise ValueError(f"{kind.simpleString()} can't be written as Avro")


def record_of(schema: T.StructType) -> dict:
    return {"type": "record", "name": "row", "fields": [{"name": f.name, "type": ["null", to_avro(f.dataType, f"row_{k}")]} for k, f in enumerate(schema)]}


def from_avro(avro) -> T.DataType:
    """The Spark type of a schema of the format."""
    if isinstance(avro, list):
        some = [x for x in avro if x != "null"]
        if len(some) != 1:
            raise ValueError(f"unions of several types aren't read: {avro}")
        return from_avro(some[0])
    if isinstance(avro, str):
        avro = {"type": avro}
    kind = avro["type"]
    if avro.get("logicalType") in _LOGICAL:
        return _LOGICAL[avro["logicalType"]][1]
    if kind == "array":
        return T.ArrayType(from_avro(avro["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), from_avro(avro["values"]))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], from_avro(f["type"])) for f in avro["fields"]])
    if isinstance(kind, str) and kind in _PRIMITIVE:
        return _PRIMITIVE[kind]
    raise ValueError(f"{avro} isn't read")


# Records


def put_long(n: int, out: bytearray) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_long(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def encoder(avro) -> Callable[[object, bytearray], None]:
    """Appends a value's bytes to a buffer."""
    if isinstance(avro, list):
        none, (other,) = avro.index("null"), [x for x in avro if x != "null"]
        absent, present, inner = bytes([2 * none]), bytes([2 * (1 - none)]), encoder(other)

        def union(x, out):
            if x is None:
                out += absent
            else:
                out += present
                inner(x, out)

        return union
    kind = avro["type"] if isinstance(avro, dict) else avro
    if kind in ("int", "long"):
        return put_long
    if kind == "boolean":
        return lambda x, out: out.append(1 if x else 0)
    if kind in ("float", "double"):
        pack = struct.Struct("<f" if kind == "float" else "<d").pack
        return lambda x, out: out.extend(pack(x))

    def sized(x, out):
        put_long(len(x), out)
        out += x

    if kind == "bytes":
        return sized
    if kind == "string":
        return lambda x, out: sized(x.encode(), out)
    if kind == "array":
        item = encoder(avro["items"])
        pairs = lambda x: x
    elif kind == "map":
        value = encoder(avro["values"])
        pairs = lambda x: x.items() if isinstance(x, dict) else x

        def item(x, out):
            sized(x[0].encode(), out)
            value(x[1], out)
    else:
        fields = [(f["name"], encoder(f["type"])) for f in avro["fields"]]

        def record(x, out):
            for name, put in fields:
                put(x[name], out)

        return record

    def several(x, out):
        x = list(pairs(x))
        if x:
            put_long(len(x), out)
            for one in x:
                item(one, out)
        out.append(0)

    return several


def decoder(avro) -> Callable[[bytes, int], tuple[object, int]]:
    """The value at a place, and the place behind it."""
    if isinstance(avro, list):
        choices = [None if x == "null" else decoder(x) for x in avro]

        def union(data, at):
            k, at = get_long(data, at)
            if not 0 <= k < len(choices):
                raise ValueError(f"no type {k} in a union of {len(choices)}")
            return choices[k](data, at) if choices[k] else (None, at)

        return union
    kind = avro["type"] if isinstance(avro, dict) else avro
    if kind in ("int", "long"):
        return get_long
    if kind == "null":
        return lambda data, at: (None, at)
    if kind == "boolean":
        return lambda data, at: (data[at] == 1, at + 1)
    if kind in ("float", "double"):
        number = struct.Struct("<f" if kind == "float" else "<d")
        return lambda data, at: (number.unpack_from(data, at)[0], at + number.size)

    def sized(data, at):
        n, at = get_long(data, at)
        if n < 0 or at + n > len(data):
            raise ValueError("a value is longer than its block")
        return data[at : at + n], at + n

    if kind == "bytes":
        return sized
    if kind == "string":

        def text(data, at):
            x, at = sized(data, at)
            return x.decode(), at

        return text
    if kind == "record":
        fields = [(f["name"], decoder(f["type"])) for f in avro["fields"]]

        def record(data, at):
            out = {}
            for name, get in fields:
                out[name], at = get(data, at)
            return out, at

        return record
    if kind == "map":
        value = decoder(avro["values"])

        def item(data, at):
            k, at = sized(data, at)
            x, at = value(data, at)
            return (k.decode(), x), at
    else:
        item = decoder(avro["items"])

    def several(data, at):
        out = []
        while True:
            n, at = get_long(data, at)
            if n == 0:
                return out, at
            if n < 0:  # the number of bytes follows
                n, (_, at) = -n, get_long(data, at)
            for _ in range(n):
                x, at = item(data, at)
                out.append(x)

    return several


# Files


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(avro: dict, codec: str, marker: bytes) -> bytes:
    out = bytearray(MAGIC)
    put_long(2, out)
    for k, v in (("avro.schema", json.dumps(avro).encode()), ("avro.codec", codec.encode())):
        for x in (k.encode(), v):
            put_long(len(x), out)
            out += x
    out.append(0)
    return bytes(out) + marker


def read_header(file) -> tuple[dict, str, bytes, int]:
    """schema, codec, marker and the place of the first marker."""
    size, head = file.size(), b""
    get = decoder({"type": "map", "values": "bytes"})
    while True:
        more = file.read_at(min(1 << 16, size - len(head)), len(head))
        head += more
        if head[:4] != MAGIC:
            raise ValueError("no Avro object container")
        try:
            meta, at = get(head, 4)
        except (IndexError, ValueError):
            if not more:
                raise ValueError("the header is cut short") from None
            continue
        if len(head) >= at + 16:
            meta = dict(meta)
            return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), head[at : at + 16], at
        if not more:
            raise ValueError("the header is cut short")


def _find(file, marker: bytes, start: int, end: int) -> int | None:
    """The first place of the marker that begins in [start, end)."""
    at, size = start, file.size()
    while at < end:
        data = file.read_at(min((1 << 20) + 15, end + 15 - at, size - at), at)
        k = data.find(marker)
        if k >= 0:
            return at + k
        at += 1 << 20
    return None


def blocks(file, start: int, end: int, marker: bytes, codec: str) -> Iterator[tuple[int, bytes]]:
    """The number and the bytes of the records of each block whose preceding marker begins in [start, end)."""
    size, at = file.size(), _find(file, marker, start, min(end, file.size()))
    while at is not None and at < end and at + 16 < size:
        head = file.read_at(min(20, size - at - 16), at + 16)
        try:
            n, k = get_long(head, 0)
            length, k = get_long(head, k)
        except IndexError:
            raise ValueError(f"a block at byte {at + 16} is cut short") from None
        begin = at + 16 + k
        if n < 0 or length < 0 or begin + length + 16 > size:
            raise ValueError(f"a block at byte {at + 16} is cut short")
        data = file.read_at(length + 16, begin)
        if data[length:] != marker:
            raise ValueError(f"a block at byte {at + 16} doesn't end in the marker")
        yield n, zlib.decompress(data[:length], -15) if codec == "deflate" else data[:length]
        at = begin + length


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Split]:
        """Files cut into splits of splitBytes."""
        step = int(self.options.get("splitbytes", SPLIT))
        return [Split(path, a, min(a + step, size)) for path, size in _files(self.options["path"]) for a in range(0, max(size, 1), step)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.options["path"])
        with system.open_input_file(split.path) as file:
            avro, codec, marker, _ = read_header(file)
            if codec not in ("null", "deflate"):
                raise ValueError(f"{split.path}: codec {codec} isn't read")
            get, arrow = decoder(avro), to_arrow_schema(self.schema)
            rows: list[dict] = []
            try:
                for n, data in blocks(file, split.start, split.end, marker, codec):
                    at = 0
                    for _ in range(n):
                        row, at = get(data, at)
                        rows.append(row)
                    if at != len(data):
                        raise ValueError(f"{len(data) - at} bytes follow the records of a block")
                    if len(rows) >= ROWS:
                        yield _batch(rows, arrow)
                        rows = []
            except (IndexError, ValueError, struct.error, zlib.error) as error:
                raise ValueError(f"{split.path}: {error}") from error
            if rows:
                yield _batch(rows, arrow)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field in arrow:
        values = [r.get(field.name) for r in rows]
        stored = pa.int64() if pa.types.is_timestamp(field.type) else pa.int32() if pa.types.is_date(field.type) else field.type
        columns.append(pa.array(values, stored).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _files(path: str) -> list[tuple[str, int]]:
    system, at = _file_system(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [(at, found.size)]
    inside = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.codec = options.get("codec", "deflate")
        if self.codec not in ("null", "deflate"):
            raise ValueError(f"codec {self.codec} isn't written")
        self.avro = record_of(schema)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = _file_system(self.options["path"])
        system.create_dir(at, recursive=True)
        path, marker = f"{at}/_part-{uuid.uuid4().hex}.avro", os.urandom(16)
        puts, out, n = [encoder(f["type"]) for f in self.avro["fields"]], bytearray(), 0
        limit = int(self.options.get("blockbytes", BLOCK))

        def end_block(file) -> None:
            data = bytes(out)
            if self.codec == "deflate":
                packer = zlib.compressobj(wbits=-15)
                data = packer.compress(data) + packer.flush()
            head = bytearray()
            put_long(n, head)
            put_long(len(data), head)
            file.write(bytes(head) + data + marker)
            out.clear()

        with system.open_output_stream(path) as file:
            file.write(_header(self.avro, self.codec, marker))
            for batch in batches:
                for row in zip(*map(_plain, batch.columns), strict=True):
                    for put, x in zip(puts, row, strict=True):
                        put(x, out)
                    n += 1
                    if len(out) >= limit:
                        end_block(file)
                        n = 0
            if n:
                end_block(file)
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _file_system(self.options["path"])
        older = _files(self.options["path"]) if self.overwrite else []
        for m in filter(None, messages):
            folder, name = m.path.rsplit("/", 1)
            system.move(m.path, f"{folder}/{name[1:]}")
        for path, _ in older:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _file_system(self.options["path"])
        for m in filter(None, messages):
            system.delete_file(m.path)


def _plain(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_timestamp(kind):
        return column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).to_pylist()
    return (column.cast(pa.int32()) if pa.types.is_date(kind) else column).to_pylist()


class AvroContainer(DataSource):
    """Options: path; splitBytes (reader); blockBytes, codec (writer)."""

    def __init__(self, options: dict):
        super().__init__({k.lower(): v for k, v in dict(options).items()})

    @classmethod
    def name(cls) -> str:
        return "avro_container"

    def schema(self) -> T.StructType:
        """That of the first file."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no files in {self.options['path']}: give a schema")
        system, _ = _file_system(self.options["path"])
        with system.open_input_file(files[0][0]) as file:
            return from_avro(read_header(file)[0])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AvroContainer)
