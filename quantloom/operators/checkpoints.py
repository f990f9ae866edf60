"""Results that are written to the shared folder, so that what reads them several times works them out once."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one a folder is made on a single machine, as in tests; a cluster
    has none that all see, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no shared folder")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that lost executors cost no recomputation."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage; what its native allocator keeps of freed memory goes back to the system.

    Planning and compiling wide plans leaves both: the heap grows until it is collected whole, and freed native
    memory stays in the arenas of the driver's threads. A JVM without the command to trim them keeps that."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    args = gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # the server's own class is not open to the gateway, its interface is
        invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


#: Removes an execution's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Chain:
    """Results that are made one from the other. Each is written as Parquet to the shared folder and takes the place
    of the one before and of those written aside since, whose files go, as do the last one's when the block ends.

    A plan ends where its result is written, so the driver handles no plan over all steps, again and again, and a
    step's shuffle files go with it. So does what the driver needed to plan it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.beside = spark, None, []

    def __enter__(self) -> Chain:
        return self

    def __exit__(self, *_: object) -> None:
        self._replace(None)
        release(self.spark)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self._write(df)
        self._replace(path)
        release(self.spark)
        return self.spark.read.parquet(path)

    def aside(self, df: DataFrame) -> DataFrame:
        """df, written; what was written before stays, too, until the next step takes the place of all."""
        self.beside.append(self._write(df))
        release(self.spark)
        return self.spark.read.parquet(self.beside[-1])

    def _write(self, df: DataFrame) -> str:
        path, conf = f"{_folder(self.spark)}/chain-{uuid.uuid4()}", self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return path

    def _replace(self, path: str | None) -> None:
        jvm, old = self.spark.sparkContext._jvm, [p for p in (self.path, *self.beside) if p]
        self.path, self.beside = path, []
        for p in old:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
