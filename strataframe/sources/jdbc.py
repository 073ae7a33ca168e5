"""Tables of a database over JDBC: partitioned reads, and aggregates that the database computes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jvm
from .scratch import shared_folder

#: Rows sent to the database, and fetched from it, at once.
BATCH = 5_000


@dataclass(frozen=True)
class Database:
    """url and driver as JDBC has them. text: the type of string columns, where the database can't compare its default
    one; columns that hold nulls keep that one, since Spark sends their nulls by its type. embedded: it is the engine in PySpark's jars."""

    url: str
    driver: str
    text: str | None = None
    embedded: bool = False

    def options(self) -> dict[str, str]:
        return {"url": self.url, "driver": self.driver, "fetchsize": str(BATCH), "batchsize": str(BATCH)}


def local_database(spark: SparkSession) -> Database:
    """A new database of the engine in PySpark's own jars, in a folder of this machine. One process opens it, so it is for
    local sessions; shared_database is for others, or a Database names a server."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("executors can't share an embedded database: name a server's url")
    at = re.sub("^file:/*", "/", shared_folder(spark, "database"))
    return Database(f"jdbc:derby:{at};create=true", "org.apache.derby.jdbc.EmbeddedDriver", "VARCHAR(32672)", True)


def shared_database(spark: SparkSession) -> Database:
    """A new database of that engine which the session's executors share. On a cluster it is in the folder of
    spark.checkpoint.dir, which must be one of files; its processes open it in turn (TurnsDriver.java), so one executor's
    tasks read or write at a time. Where that is too slow a Database names a server."""
    if spark.sparkContext.master.startswith("local["):
        return local_database(spark)
    if not spark.conf.get("spark.checkpoint.dir", "/").startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir is no folder of files: name a server's url")
    at = re.sub("^file:/*", "/", shared_folder(spark, "database"))
    spark._jvm.java.lang.Thread.currentThread().setContextClassLoader(jvm.loader(spark))
    return Database(f"jdbc:derbyturns:{at}", "strataframe.TurnsDriver", "VARCHAR(32672)", True)


def write(df: DataFrame, database: Database, name: str, connections: int = 8) -> None:
    """Adds df to a table, over so many connections at most. Times without zone go as the session zone's."""
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    writer = df.coalesce(connections).write.format("jdbc").options(**database.options(), dbtable=name).mode("append")
    names = [c for c, kind in df.dtypes if kind == "string"] if database.text else []
    lacking = df.agg(*(F.max(F.col(c).isNull()).alias(c) for c in names)).first() if names else {}
    texts = [f"{c} {database.text}" for c in names if not lacking[c]]
    typed = {"createTableColumnTypes": ", ".join(texts)} if texts else {}
    if database.embedded:
        df.limit(0).write.format("jdbc").options(**database.options(), **typed, dbtable=name).mode("append").save()
        _by_tables(df.sparkSession, database, name)
    writer.options(**typed).save()


def _by_tables(spark: SparkSession, database: Database, name: str) -> None:
    """Writers lock the table, each as long as its rows take, and wait without end: the embedded engine keeps a lock
    for each row of a transaction in memory, as many as a task has rows, where several of them write."""
    kinds = jvm.loader(spark) if database.driver.startswith("strataframe.") else spark._jvm.java.lang.ClassLoader.getSystemClassLoader()
    gateway = spark.sparkContext._gateway
    driver = kinds.loadClass(database.driver).getDeclaredConstructor(gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(gateway.new_array(spark._jvm.java.lang.Object, 0))
    connection = driver.connect(database.url, spark._jvm.java.util.Properties())
    try:
        for said in ("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.locks.waitTimeout', '-1')", f"ALTER TABLE {name} LOCKSIZE TABLE"):
            statement = connection.createStatement()
            statement.execute(said)
            statement.close()
    finally:
        connection.close()


def read(spark: SparkSession, database: Database, name: str, column: str, parts: int = 8) -> DataFrame:
    """The table in parts by ranges of a number column, between its least and greatest value, which the database is
    asked for. Every row is in one part, whatever the bounds; nulls are in the first. Filters and columns are the database's work."""
    reader = lambda: spark.read.format("jdbc").options(**database.options())
    bounds = reader().option("query", f'SELECT min("{column}") AS lo, max("{column}") AS hi FROM {name}').load().first()
    lo, hi = (int(x) if x is not None else 0 for x in bounds)
    return reader().options(dbtable=name, partitionColumn=column, lowerBound=lo, upperBound=hi + 1, numPartitions=min(parts, max(1, hi - lo + 1))).load()


def catalog(spark: SparkSession, database: Database, name: str) -> str:
    """Registers the database as a catalog of the session, under which the database groups and sums. Returns its name."""
    prefix = f"spark.sql.catalog.{name}"
    for k, v in {**database.options(), "pushDownAggregate": "true", "pushDownLimit": "true"}.items():
        spark.conf.set(f"{prefix}.{k}", v)
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    return name


def forget(spark: SparkSession, database: Database) -> None:
    """Closes an embedded database, so that its folder can be deleted."""
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.sql.DriverManager.getConnection(database.url.replace("create=true", "shutdown=true"))
    except Exception:  # a shutdown is told by an exception
        pass
