"""Helpers that the training-data operators share: table access, staging and text columns."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting to delete a query's shuffle files when the query ends, rather than when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="veilspark-code-")) / "veilspark_code.zip"  # the driver serves it to executors
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted([*top.rglob("*.py"), *top.rglob("*.npz")]):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/veilspark/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`stage` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_given_back = [0.0]


def give_back(spark: SparkSession, seconds: float = 2.0) -> None:
    """Let the driver's JVM return the native memory that its allocator keeps after planning and compiling; once in some seconds.

    A run of many stages would else hold on to hundreds of MB that are free. Where the JVM has no such command, nothing happens.
    """
    if time.monotonic() - _given_back[0] < seconds:
        return
    _given_back[0] = time.monotonic()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # The server's class is hidden, so its method is taken from the public interface.
        of = jvm.java.lang.Class.forName
        kinds = array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        values = array(jvm.java.lang.Object, command, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks of the current stage, not the
    scan of all texts, and whatever reads the result twice computes it once.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the rows are written, so nothing reads this job's shuffle files again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    give_back(spark)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with key, a struct of two longs that is another for every row and the same whenever docs is read again.

    Rows read from Parquet are told apart by their file and their place in it, which costs no copy of the texts; other rows
    are numbered and written to the shared folder.
    """
    try:
        return docs.withColumn(key, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return stage(docs.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "keyed")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
