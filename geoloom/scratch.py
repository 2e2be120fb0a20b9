"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, a new one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_geoloom_shared", None) or tempfile.mkdtemp(prefix="geoloom-")
        spark._geoloom_shared = found
    return found.rstrip("/")


#: Share of its greatest size from which the driver's heap is collected after a written table.
_HEAP = 0.6


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then are the broadcasts of ended queries dropped, with their buffers, and the
    heap given back. Left to itself the heap grows to its limit first."""
    spark._jvm.System.gc()


def release_if_grown(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to a share of its limit: the plans of many queries leave it
    there, and pages that the heap has once used stay the driver's until it shrinks."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > _HEAP * heap.maxMemory():
        release(spark)


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    Each call of an operator has a folder of its own under the shared folder. Tables that a result still reads stay
    until the driver ends; ``drop`` frees the others earlier.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/geoloom-{label}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.path)

    def table(self, df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
        at = f"{self.path}/{name}"
        self.drop(name)
        options = self._place(at)
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")  # what was shuffled for a written table isn't needed again
        try:
            df.write.mode("append").options(compression=codec, **options).parquet(at)
        finally:
            self.spark.conf.set(_CLEAN, before)
        release_if_grown(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def _place(self, at: str) -> dict[str, str]:
        """Make the folders of a new table, if they are local ones; options for its writer.

        Without its native library Hadoop starts a chmod for every local folder and file that it makes, and until that
        child runs it shares the memory of its JVM, which is then seen twice. So folders are made beforehand, and the
        scratch files have neither a checksum file nor a marker beside them.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(at)
        system = path.getFileSystem(conf)
        if system.getScheme() != "file":
            return _NO_MARK
        jvm.java.io.File(system.makeQualified(path).toUri().getPath(), "_temporary/0/_temporary").mkdirs()
        return _NO_MARK | _RAW

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Delete all tables of this folder, and what their queries left in the driver."""
        self._delete(self.path)
        release(self.spark)

    def _delete(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may have ended before the interpreter does
            pass
