"""JVM classes from the Java sources beside this package (typed aggregators, a JDBC driver): compiled against Spark's own
jars, added to the session."""

from __future__ import annotations

import os
import subprocess
import tempfile
import threading
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

SOURCES = Path(__file__).resolve().parent.parent / "jvm"
#: The jar of each Spark application, which takes one of a name; queries that run side by side ask for it at once.
_JARS: dict[str, str] = {}
_BUILDING = threading.Lock()


def built(javac: str = "javac") -> str:
    """Compiles the sources and returns the path of a jar of theirs. Raises where there is no compiler."""
    folder = Path(tempfile.mkdtemp(prefix="spark-jvm-", dir="/tmp"))
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "*")
    done = subprocess.run([javac, "-nowarn", "-cp", jars, "-d", str(folder / "out"), *map(str, sorted(SOURCES.glob("*.java")))], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"the Java sources don't compile: {done.stderr}")
    with zipfile.ZipFile(folder / "strataframe.jar", "w") as jar:
        for f in sorted((folder / "out").rglob("*.class")):
            jar.write(f, f.relative_to(folder / "out"))
    return str(folder / "strataframe.jar")


def loader(spark: SparkSession):
    """The session's class loader, with the sources' jar: built once for each application, it goes to the executors with each session."""
    app = spark.sparkContext.applicationId
    with _BUILDING:
        if not getattr(spark, "_strataframe_jar", None):
            if app not in _JARS:
                _JARS[app] = built()
            spark.sql(f"ADD JAR '{_JARS[app]}'")
            spark._strataframe_jar = _JARS[app]
    return spark._jsparkSession.artifactManager().classloader()


def register_aggregator(spark: SparkSession, name: str, kind: str) -> None:
    """Makes strataframe.<kind>, an aggregator of doubles, a function of the session."""
    jvm, session = spark._jvm, spark._jsparkSession
    kinds = loader(spark).loadClass(f"strataframe.{kind}")
    gateway = spark.sparkContext._gateway
    made = kinds.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    session.udf().register(name, jvm.org.apache.spark.sql.functions.udaf(made, jvm.org.apache.spark.sql.Encoders.DOUBLE()))
