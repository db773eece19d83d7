"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where a single-machine session names none. On a cluster that is an error:
    executors don't share the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_shoebox_scratch", None) or tempfile.mkdtemp(prefix="shoebox-")
        spark.sparkContext._shoebox_scratch = root
    return root.rstrip("/")


#: Spark removes the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage is cut, lost executors cost
    nothing that was written, later plans see real sizes, and the shuffle files behind it go at once. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if getattr(_here, "made", None) is not None:
        _here.made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_here = threading.local()


@contextmanager
def noted():
    """A list of the tables that this thread materialises inside the block, in order."""
    outer, _here.made = getattr(_here, "made", None), []
    try:
        yield _here.made
    finally:
        inner, _here.made = _here.made, outer
        if outer is not None:
            outer += inner


def drop_but_last(spark: SparkSession, made: list[str]) -> None:
    """Delete the tables of a list but its last one: what led to that isn't needed once it is written."""
    for path in made[:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del made[:-1]
