"""The database source: parts, pushed work, nulls."""

from __future__ import annotations

import contextlib
import io
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from strataframe.functions import jvm
from strataframe.plans import registry
from strataframe.sources import jdbc


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_the_database_filters_and_groups(spark, sf_dir):
    queries = registry.queries()
    got = _plan(queries["a7_jdbc_pushed_filter"](spark, sf_dir))
    assert "GreaterThan(o_totalprice,300000.0)" in got and "EqualTo(o_orderstatus,F)" in got and "numPartitions=8" in got
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in got
    got = _plan(queries["a7_jdbc_pushed_aggregate"](spark, sf_dir))
    assert "PushedAggregates: [COUNT(*), MAX(o_orderkey), SUM(o_totalprice)]" in got and "PushedGroupByExpressions: [o_orderstatus]" in got and "Exchange" not in got


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_every_row_is_in_one_part(spark, parts):
    """Nulls and the greatest value too, also with more parts than values."""
    database = jdbc.local_database(spark)
    df = spark.range(20).select(F.when(F.col("id") > 0, F.col("id") % 7 - 3).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, F.lit("ü'\"")).alias("s"), F.lit("it's").alias("t"))
    jdbc.write(df, database, "T")
    back = jdbc.read(spark, database, "T", "k", parts)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert back.rdd.getNumPartitions() == min(parts, 7)
    assert back.filter("t = 'it''s'").count() == 20
    jdbc.forget(spark, database)


def test_an_empty_table(spark):
    database = jdbc.local_database(spark)
    jdbc.write(spark.range(0).select(F.col("id").alias("k")), database, "T")
    assert jdbc.read(spark, database, "T", "k").count() == 0


def test_writers_lock_the_table_not_each_row(spark):
    """Locks of rows are kept in memory, as many as a task writes."""
    database = jdbc.local_database(spark)
    jdbc.write(spark.range(0, 40_000, 1, 4).select(F.col("id").alias("k")), database, "T")
    locked = spark.read.format("jdbc").options(**database.options(), query="SELECT LOCKGRANULARITY AS g FROM SYS.SYSTABLES WHERE TABLENAME = 'T'").load()
    assert locked.first()[0] == "T"
    jdbc.write(spark.range(40_000, 40_010).select(F.col("id").alias("k")), database, "T")
    assert jdbc.read(spark, database, "T", "k").agg(F.count("k"), F.sum("k")).first()[:] == (40_010, sum(range(40_010)))
    jdbc.forget(spark, database)


def test_an_embedded_database_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="server"):
        jdbc.local_database(Session)


_CLUSTER = """
import sys
from pyspark.sql import SparkSession

scratch, sf_dir, name = sys.argv[1:]
conf = {"spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{scratch}/shared", "spark.local.dir": scratch}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()

from strataframe.plans import registry
from tests.oracle import assert_same

assert_same(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])
spark.stop()
"""


@pytest.mark.parametrize("name", ["a7_jdbc_pushed_aggregate", "a7_jdbc_pushed_filter", "a7_jdbc_round_trip"])
def test_executors_share_a_database_in_turns(sf_dir, tmp_path, name):
    """Driver and executors are processes of their own here; each may open the embedded database only in its turn."""
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", _CLUSTER, str(tmp_path), sf_dir, name], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_shared_database_needs_a_folder_of_files():
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda *_: "hdfs://host/checkpoints")

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="server"):
        jdbc.shared_database(Session)


_CROSS = """
import java.nio.file.*;
import java.sql.*;
import java.util.*;

public class Cross {
  static Connection taken(String at) throws Exception {
    Connection made = ((Driver) Class.forName("strataframe.TurnsDriver").getDeclaredConstructor().newInstance()).connect("jdbc:derbyturns:" + at, new Properties());
    made.setAutoCommit(false);
    return made;
  }

  public static void main(String[] at) throws Exception {
    Connection own = taken(at[0]);
    Files.createFile(Path.of(at[0] + ".taken"));
    while (!Files.exists(Path.of(at[1] + ".taken"))) Thread.sleep(20);
    Exception[] failed = {null};
    Thread other = new Thread(() -> {
      try {
        taken(at[1]).close();
      } catch (Exception e) {
        failed[0] = e;
      }
    });
    other.start();
    Thread.sleep(2000);
    own.close();
    other.join();
    if (failed[0] != null) throw new Exception(failed[0]);
  }
}
"""


def test_processes_wait_for_each_others_turns(tmp_path):
    """Two queries side by side: an executor has a turn at one database and waits for the other, another the reverse."""
    (tmp_path / "Cross.java").write_text(_CROSS)
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    command = ["java", "-cp", f"{jvm.built()}:{jars}", "Cross.java"]
    run = [subprocess.Popen([*command, *at], cwd=tmp_path, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True) for at in ((f"{tmp_path}/a", f"{tmp_path}/b"), (f"{tmp_path}/b", f"{tmp_path}/a"))]
    said = [p.communicate(timeout=120)[0] for p in run]
    assert [p.returncode for p in run] == [0, 0], said


def test_a_connection_that_gave_up_its_turn_tells_without_it(spark, tmp_path):
    """Spark asks a reader's connection for its mode at the end of each part."""
    kinds, gateway = jvm.loader(spark), spark.sparkContext._gateway
    driver = kinds.loadClass("strataframe.TurnsDriver").getDeclaredConstructor(gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(gateway.new_array(spark._jvm.java.lang.Object, 0))
    connection = driver.connect(f"jdbc:derbyturns:{tmp_path}/a", spark._jvm.java.util.Properties())
    statement = connection.createStatement()
    assert (tmp_path / "a" / "database" / "db.lck").exists()
    statement.close()
    (tmp_path / "a").rename(tmp_path / "b")
    assert connection.getAutoCommit() and not (tmp_path / "a").exists()
    connection.close()


def test_sessions_of_an_application_share_a_jar(spark):
    sessions = [spark.newSession(), spark.newSession()]
    for s in sessions:
        jvm.loader(s).loadClass("strataframe.TurnsDriver")
    assert sessions[0]._strataframe_jar == sessions[1]._strataframe_jar
