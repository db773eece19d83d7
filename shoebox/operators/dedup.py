"""Byte-identical files (A-01, A-02, A-07, A-08, J-04, K-01)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

PREFIX_BYTES = 65536


def several(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once. The keys are counted first with map-side sums, so one very common
    key costs a row for each task, and the join that follows can be split by AQE."""
    often = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(often, list(keys), "left_semi")


def size_candidates(files: DataFrame) -> DataFrame:
    """J-04: non-empty files whose size occurs more than once."""
    return several(files.where("size > 0"), "size")


def find_duplicates(files: DataFrame, quick: Column | Callable, full: Column | Callable, prefilter: bool = True, staged: bool = True) -> DataFrame:
    """A-01: (file_id, path, size, content_hash) of files whose bytes occur more than once.

    Size, then the hash of a prefix, then the hash of everything; each stage looks only at what the one before left.
    quick and full are columns over `files` (id, path, size and what they read), null where a file can't be read:
    such files drop out. staged: write the survivors between stages, so bytes are read once.
    """
    left = size_candidates(files)
    keep = (lambda df, name: materialise(df, name)) if staged else (lambda df, name: df)
    if prefilter:
        hashed = keep(left.withColumn("quick_hash", quick).where("quick_hash IS NOT NULL"), "dedup-quick")
        left = several(hashed, "size", "quick_hash").drop("quick_hash")
    hashed = keep(left.withColumn("content_hash", full).where("content_hash IS NOT NULL").select(F.col("id").alias("file_id"), "path", "size", "content_hash"), "dedup-full")
    return several(hashed, "content_hash")


def group_duplicates(found: DataFrame) -> DataFrame:
    """K-01, A-07: (group_id, file_id, is_representative, content_hash, path, size). Groups are numbered by their smallest
    file id; the representative has the shortest path, then the first."""
    keys = found.groupBy("content_hash").agg(
        F.min("file_id").alias("first"),
        F.min_by("file_id", F.struct(F.length("path"), "path", "file_id")).alias("best"),
    )
    keys = number_groups(keys, "first")
    return found.join(keys, "content_hash").select("group_id", "file_id", (F.col("file_id") == F.col("best")).alias("is_representative"), "content_hash", "path", "size")


def number_groups(groups: DataFrame, by: str) -> DataFrame:
    """Gapless group_id from 1 in the order of a unique column, without sorting everything in one task: ranges get
    local numbers, and the counts of the ranges before are added."""
    spark = groups.sparkSession
    ranged = groups.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by)
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "group-ranges")
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each range: as many as there are shuffle partitions
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn("group_id", (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_rank", "_before")


def redundant(groups: DataFrame) -> DataFrame:
    """A-08: (groups, redundant): how many groups there are, and files beyond one in each."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("redundant"))
