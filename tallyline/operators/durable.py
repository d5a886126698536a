"""Intermediate tables of iterative operators, in the folder that the cluster names in ``spark.checkpoint.dir``.

A table that is read more than once is written there, so that a lost executor
costs a re-read and never a recomputation from lost local blocks. The folder of
a ``Durable`` is deleted when the session's JVM ends; tables that no later step
reads are deleted before.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is named, a local session (tests) gets a fresh one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def release(spark: SparkSession) -> None:
    """Give back what finished jobs have left: broadcasts and shuffle files that nothing refers to any more, and memory of the
    driver that its heap and its C allocator hold on to.

    Spark's cleaner acts when the driver's JVM collects, which it may not do for long while the executors fill up.
    """
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    # what "jcmd System.trim_native_heap" does, where the JVM has it; the bean's class is not public, its interface is
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    beans = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}
    call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        beans["invoke"].invoke(server, call)
    except Py4JJavaError:  # not in every JVM
        pass


class Durable:
    """Parquet tables under one folder of their own in the shared folder."""

    def __init__(self, spark: SparkSession):
        release(spark)
        self.spark = spark
        self.root = f"{folder(spark)}/tallyline-{uuid.uuid4().hex}"
        self.made = 0

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it reread, with its lineage cut."""
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        df.write.parquet(path)
        if self.made == 1:
            target, files = self._at(self.root)
            files.deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._durable_path = path
        return out

    def release(self) -> None:
        release(self.spark)

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            path = getattr(df, "_durable_path", None)
            if path:
                target, files = self._at(path)
                files.delete(target, True)
