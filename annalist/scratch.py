"""Tables written once to a shared folder, from which later stages start."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of this
    process only where that is unset and the master is local."""
    global _OWN_SCRATCH
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_SCRATCH is None:
        _OWN_SCRATCH = tempfile.mkdtemp(prefix="annalist-scratch-")
        atexit.register(shutil.rmtree, _OWN_SCRATCH, ignore_errors=True)
    return "file://" + _OWN_SCRATCH


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages
    start from files that survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and plans of what nothing refers to any
    more: its cleaner learns of them from the driver's garbage collection alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
