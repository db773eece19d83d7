"""Rules that keep one member of every group (J-08, J-09, J-12, U-02, U-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import active


def protected_in(groups: DataFrame, files: DataFrame, request: DataFrame, flag: str) -> DataFrame:
    """J-08 for one group table (group_id, file_id, flag): of each group whose active members are all requested, the
    smallest flagged id, else the smallest id."""
    wanted = request.select(F.col("id").alias("file_id")).distinct().withColumn("wanted", F.lit(True))
    members = groups.join(active(files).select(F.col("id").alias("file_id")), "file_id", "left_semi").join(wanted, "file_id", "left")
    by_group = members.groupBy("group_id").agg(
        F.bool_and(F.coalesce("wanted", F.lit(False))).alias("everything"),
        F.min(F.when(F.col(flag), F.col("file_id"))).alias("flagged"),
        F.min("file_id").alias("smallest"),
    )
    return by_group.where("everything").select(F.coalesce("flagged", "smallest").alias("id"))


def protected_survivors(duplicates: DataFrame, similar: DataFrame, files: DataFrame, request: DataFrame) -> DataFrame:
    """J-08, U-02: over both kinds of groups."""
    return protected_in(duplicates, files, request, "is_representative").union(protected_in(similar, files, request, "is_best_shot")).distinct()


def targets(request: DataFrame, protected: DataFrame) -> DataFrame:
    """J-12: requested ids without protected ones."""
    return request.select("id").distinct().join(protected, "id", "left_anti")


def collapse_duplicates(similar: DataFrame, duplicates: DataFrame) -> DataFrame:
    """J-09: similar groups without copies that aren't representatives, and without groups of fewer than two."""
    copies = duplicates.where("NOT is_representative").select("file_id")
    left = similar.join(copies, "file_id", "left_anti")
    big = left.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return left.join(big, "group_id", "left_semi")
