"""The Avro container source: types, splits of any size, broken files, tasks that failed."""

from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataframe.sources import avro as op

SCHEMA = "b boolean, i int, l long, f float, d double, s string, x binary, day date, at timestamp, local timestamp_ntz, a array<string>, m map<string, long>, r struct<p: int, q: array<double>>"


@pytest.fixture(scope="module")
def rows(spark):
    op.register(spark)
    day, at = dt.date(1969, 7, 20), dt.datetime(1999, 12, 31, 23, 59, 59, 123456)
    some = [(True, -1, 2**63 - 1, 0.5, -1e300, "ü\u0000", b"\x00\xff", day, at, at, ["x", None, ""], {"k": 1, "n": None}, (7, [1.0, None])), (False, -(2**31), -(2**63), 0.0, 0.0, "", b"", day, at, at, [], {}, (None, None)), (None,) * 13]
    return spark.createDataFrame(some * 40, SCHEMA)


def _same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("codec", ["null", "deflate"])
@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_round_trip_in_splits(spark, rows, tmp_path, codec, split):
    at = f"file://{tmp_path}/t"
    rows.coalesce(2).write.format("avro_container").option("codec", codec).option("blockBytes", 300).mode("append").save(at)
    assert sorted(n[-5:] for n in os.listdir(tmp_path / "t")) == [".avro"] * len(os.listdir(tmp_path / "t"))
    back = spark.read.format("avro_container").option("splitBytes", split if split > 50 else 50).load(at)
    assert back.schema.simpleString() == rows.schema.simpleString()
    _same(back, rows)


def _file(tmp_path, n=200, block=64):
    writer = op.Writer(op.T.StructType().add("k", "long").add("s", "string"), {"path": str(tmp_path), "blockbytes": block, "codec": "null"}, False)
    batch = pa.RecordBatch.from_pydict({"k": list(range(n)), "s": [f"t{k}" for k in range(n)]})
    done = writer.write(iter([batch]))
    writer.commit([done])
    return next(tmp_path.glob("*.avro"))


def _keys(path, start, end):
    reader = op.Reader(op.T.StructType().add("k", "long"), {"path": str(path)})
    return [k for b in reader.read(op.Split(str(path), start, end)) for k in b.column("k").to_pylist()]


def test_each_row_once_wherever_the_splits_are(tmp_path):
    path = _file(tmp_path)
    size = path.stat().st_size

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.integers(0, size), max_size=12))
    def check(cuts):
        edges = sorted({0, size, *cuts})
        assert sorted(k for a, b in zip(edges, edges[1:], strict=False) for k in _keys(path, a, b)) == list(range(200))

    check()


def test_a_broken_block_is_an_error(tmp_path):
    path = _file(tmp_path)
    data = path.read_bytes()
    with open(path, "rb") as f:
        _, _, marker, first = op.read_header(pa.PythonFile(f, mode="r"))
    places = [k for k in range(len(data)) if data.startswith(marker, k)]
    assert len(places) > 10
    for broken in (
        data[: places[5] - 3] + data[places[5] - 2 :],  # a byte is missing
        data[: places[5]] + b"\x00" + data[places[5] + 1 :],  # another marker
        data[:-1],  # cut short
        data[: places[4] + 17],
        data[: places[4] + 16] + b"\x02" + data[places[4] + 17 :],  # another number of records
    ):
        path.write_bytes(broken)
        with pytest.raises(ValueError, match=r"\.avro: .*block"):
            for a in range(0, len(broken), 97):
                _keys(path, a, min(a + 97, len(broken)))
    for no_file in (b"", b"Obj\x01", b"text", data[: first + 8]):
        path.write_bytes(no_file)
        with pytest.raises(ValueError, match="header|container"):
            _keys(path, 0, 10)


def test_what_failed_tasks_left_isnt_read(tmp_path):
    writer = op.Writer(op.T.StructType().add("k", "long"), {"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2]})
    kept, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None])
    assert [n for p, size in op._files(str(tmp_path)) for n in _keys(p, 0, size)] == [1, 2]
    writer.abort([lost])
    assert len(os.listdir(tmp_path)) == 1


def test_append_and_overwrite(spark, tmp_path):
    op.register(spark)
    at, df = f"file://{tmp_path}/t", spark.range(5)
    for mode, n in (("append", 5), ("append", 10), ("overwrite", 5)):
        df.write.format("avro_container").mode(mode).save(at)
        assert spark.read.format("avro_container").load(at).count() == n
    empty = f"file://{tmp_path}/none"
    df.limit(0).write.format("avro_container").mode("append").save(empty)
    assert spark.read.format("avro_container").schema("id long").load(empty).count() == 0


def test_a_schema_that_names_other_fields(spark, tmp_path):
    op.register(spark)
    spark.range(3).withColumn("s", F.lit("x")).write.format("avro_container").mode("append").save(f"file://{tmp_path}/t")
    back = spark.read.format("avro_container").schema("s string, other long").load(f"file://{tmp_path}/t")
    assert [tuple(r) for r in back.collect()] == [("x", None)] * 3


def test_other_writers_files():
    """Blocks of arrays with a byte count, and unions with null last."""
    avro = {"type": "record", "name": "r", "fields": [{"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "n", "type": ["int", "null"]}]}
    assert op.from_avro(avro).simpleString() == "struct<a:array<int>,n:int>"
    assert op.decoder(avro)(bytes([3, 4, 2, 4, 0, 2]), 0) == ({"a": [1, 2], "n": None}, 6)
    out = bytearray()
    op.encoder(["int", "null"])(5, out)
    op.encoder(["int", "null"])(None, out)
    assert bytes(out) == bytes([0, 10, 2])


@given(st.integers(-(2**63), 2**63 - 1))
def test_numbers(n):
    out = bytearray()
    op.put_long(n, out)
    assert op.get_long(bytes(out), 0) == (n, len(out)) and len(out) <= 10


def test_types_that_arent_written():
    for kind in ("decimal(10,2)", "array<timestamp>", "map<int,int>"):
        with pytest.raises(ValueError, match="Avro"):
            op.record_of(op.T.StructType().add("k", op.T._parse_datatype_string(kind) if hasattr(op.T, "_parse_datatype_string") else kind))

