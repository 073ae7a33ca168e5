"""Sinks and sources in the file formats of Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # the default keeps milliseconds only
#: By format: options of the writer, options of the reader.
OPTIONS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "parquet": ({}, {}),
    "orc": ({}, {}),
    "csv": (_TIME | {"header": "true", "escape": '"'}, _TIME | {"header": "true", "escape": '"', "enforceSchema": "false", "mode": "FAILFAST"}),
    "json": (_TIME | {"ignoreNullFields": "false"}, _TIME | {"mode": "FAILFAST"}),
    "xml": (_TIME | {"rowTag": "row", "rootTag": "rows"}, _TIME | {"rowTag": "row", "mode": "FAILFAST"}),
}


def write(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(kind).options(**OPTIONS[kind][0])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """Reads with the schema that was written: inference would scan the files and change types."""
    return spark.read.format(kind).schema(schema).options(**OPTIONS[kind][1]).load(path)


def round_trip(df: DataFrame, path: str, kind: str) -> DataFrame:
    write(df, path, kind)
    return read(df.sparkSession, path, kind, df.schema)
