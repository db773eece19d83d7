"""Report and view tables (J-01, J-02, A-03 to A-13, P-03 to P-10, P-18, P-19, W-09, F-23, F-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import time_label
from ..functions.paths import basename
from ..schema import active
from . import dedup
from .bestshot import reason_of
from .protect import collapse_duplicates

# Labels in reports.
ACTIONS = {"trash": "휴지통", "quarantine": "격리", "move": "이동"}
REPRESENTATIVE, BEST, UNDONE = "대표", "베스트샷", "취소됨"


def count_active(files: DataFrame) -> DataFrame:
    """A-03."""
    return active(files).agg(F.count("*").alias("n"))


def category_counts(files: DataFrame) -> DataFrame:
    """A-04, O-06."""
    return active(files).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def category_total(files: DataFrame) -> DataFrame:
    """A-13: how many files the categories hold together."""
    return category_counts(files).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def size_candidates(files: DataFrame) -> DataFrame:
    """J-04 as a list, O-01: candidates in the order of their sizes."""
    return dedup.size_candidates(active(files)).orderBy("size", "id")


def similar_thumbs(groups: DataFrame, files: DataFrame) -> DataFrame:
    """J-03, O-07: members of similar groups with their thumbnails, by group; removed files aren't left out."""
    return groups.select("group_id", "file_id").join(files.select(F.col("id").alias("file_id"), "thumb_path"), "file_id").orderBy("group_id", "file_id").select("group_id", "file_id", "thumb_path")


def needs_analysis(files: DataFrame) -> DataFrame:
    """P-03."""
    return active(files).where("phash IS NULL AND scan_status <> 'error'").orderBy("id")


def by_category(files: DataFrame, category: str | None = None) -> DataFrame:
    """P-04: one category, or every classified file."""
    rows = active(files)
    return rows.where(F.col("category") == category if category else F.col("category").isNotNull()).orderBy("id")


def with_signature(files: DataFrame) -> DataFrame:
    """P-05."""
    return active(files).where("phash IS NOT NULL AND phash <> ''").select("id", "phash", "exif_dt")


def paths_for(files: DataFrame, ids: DataFrame) -> DataFrame:
    """P-08."""
    return files.join(ids.select("id").distinct(), "id", "left_semi").select("id", "path")


def undoable(log: DataFrame) -> DataFrame:
    """P-09."""
    return log.where(~F.col("undone") & F.col("action").isin("quarantine", "move"))


def last_undoable(log: DataFrame) -> DataFrame:
    """A-06: the last batch that can be undone, null if none."""
    return undoable(log).agg(F.max("batch").alias("batch"))


def in_batch(log: DataFrame, batch: int) -> DataFrame:
    """P-10."""
    return log.where((F.col("batch") == batch) & ~F.col("undone"))


def duplicate_rows(groups: DataFrame, files: DataFrame) -> DataFrame:
    """J-01, O-02: members of duplicate groups that are active."""
    rows = groups.join(active(files).withColumnRenamed("id", "file_id"), "file_id")
    if "content_hash" in groups.columns:
        rows = rows.drop(groups["content_hash"])
    return rows.orderBy("group_id", F.desc("is_representative"), "path")


def similar_rows(groups: DataFrame, files: DataFrame) -> DataFrame:
    """J-02, O-03: members of similar groups that are active."""
    return groups.join(active(files).withColumnRenamed("id", "file_id"), "file_id").orderBy("group_id", F.desc("is_best_shot"), F.desc("quality_score"), "path")


def _flag(c: str, label: str) -> Column:
    return F.when(F.col(c), label).otherwise("").alias(c)


def duplicate_report(groups: DataFrame, files: DataFrame) -> DataFrame:
    return duplicate_rows(groups, files).select("group_id", _flag("is_representative", REPRESENTATIVE), "size", "content_hash", "path")


def similar_report(groups: DataFrame, files: DataFrame) -> DataFrame:
    return similar_rows(groups, files).select("group_id", _flag("is_best_shot", BEST), "quality_score", "similarity_score", F.coalesce("category", F.lit("")).alias("category"), "path")


def similar_listing(groups: DataFrame, files: DataFrame) -> DataFrame:
    """K-16: the report of similar groups with the reason of each score."""
    rows = similar_rows(groups, files)
    return rows.select("group_id", _flag("is_best_shot", BEST), "similarity_score", F.coalesce("category", F.lit("")).alias("category"), "path", F.coalesce(reason_of(F.col("quality_detail")), F.lit("")).alias("reason"))


def action_label(action: Column) -> Column:
    """F-23."""
    out = action
    for name, label in ACTIONS.items():
        out = F.when(action == name, label).otherwise(out)
    return out


def action_report(log: DataFrame) -> DataFrame:
    """P-18, O-04."""
    rows = log.orderBy("batch", "id")
    return rows.select(time_label(F.col("timestamp")).alias("timestamp"), action_label(F.col("action")).alias("action"), "batch", _flag("undone", UNDONE), "from_path", F.coalesce("to_path", F.lit("")).alias("to_path"))


def group_heads(rows: DataFrame, *order: str | Column) -> DataFrame:
    """W-09: rows with `is_head`, true on each group's first row in the order given."""
    return rows.withColumn("is_head", F.row_number().over(Window.partitionBy("group_id").orderBy(*order)) == 1)


def members_total(groups: DataFrame) -> DataFrame:
    """A-09, A-10: how many groups, how many members."""
    return groups.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("members"))


def _view(rows: DataFrame, title: str, *extra: Column) -> DataFrame:
    item = F.struct(F.col("_order"), "label", "tooltip", "thumb_path", "path", "file_id", "keep", "size", "category", F.col("category_confidence").alias("confidence"), *extra)
    groups = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return groups.select("group_id", F.format_string(title, F.col("group_id"), F.size("items")).alias("title"), "items")


def duplicate_view(groups: DataFrame, files: DataFrame) -> DataFrame:
    """P-19, F-28: one row for each duplicate group with its items in order."""
    rows = duplicate_rows(groups, files)
    rows = rows.withColumn("keep", F.col("is_representative")).withColumn("_order", F.struct(~F.col("keep"), F.col("path").alias("p")))
    rows = rows.withColumn("label", F.concat(F.when(F.col("keep"), "★ 대표").otherwise(""), F.lit("\n"), basename(F.col("path")))).withColumn("tooltip", F.concat("path", F.lit("\n(더블클릭: 원본 열기)")))
    return _view(rows, "완전 중복 그룹 %d · %d장")


def similar_view(groups: DataFrame, duplicates: DataFrame, files: DataFrame) -> DataFrame:
    """P-19, F-28, J-09: similar groups without copies, of two and more."""
    rows = similar_rows(collapse_duplicates(groups, duplicates), files)
    counts = rows.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    rows = rows.join(counts, "group_id", "left_semi").withColumn("keep", F.col("is_best_shot")).withColumn("reason", reason_of(F.col("quality_detail")))
    rows = rows.withColumn("_order", F.struct(~F.col("keep"), (-F.col("quality_score")).alias("q"), F.col("path").alias("p")))
    rows = rows.withColumn("label", F.concat(F.when(F.col("keep"), "⭐").otherwise(""), F.lit(" "), basename(F.col("path"))))
    rows = rows.withColumn("tooltip", F.concat("path", F.format_string("\n유사도 %.3f\n", "similarity_score"), "reason", F.lit("\n(더블클릭: 원본 열기)")))
    return _view(rows, "유사 그룹 %d · %d장", F.col("similarity_score").alias("similarity"), F.col("keep").alias("is_best"), F.col("reason"))


def extras(view: DataFrame) -> DataFrame:
    """P-17: ids of items that a view doesn't keep."""
    return view.select(F.explode("items").alias("i")).where("NOT i.keep AND i.file_id IS NOT NULL").select("i.file_id")
