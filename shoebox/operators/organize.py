"""Moving files into month folders: the plan, its preview, and name collisions (M-12, A-11, O-09, O-10, W-10, P-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import month_folder, resolve_date
from ..functions.paths import basename, dirname, nfc, stem
from ..schema import active

UNKNOWN_FOLDER = "_날짜미상"  # Fixed value: where files without a date go


def plan(files: DataFrame, root: str, unknown: str = UNKNOWN_FOLDER, as_of=None, compose: bool = True) -> DataFrame:
    """M-12: (file_id, src, dest_dir, source, skip) of active files; nothing is moved. as_of: the day that counts as today."""
    day, source = resolve_date(F.col("exif_dt"), basename(F.col("path")), F.current_date() if as_of is None else F.to_date(F.lit(as_of)))
    rows = active(files).select(F.col("id").alias("file_id"), F.col("path").alias("src"), day.alias("_day"), source.alias("source"))
    dest = F.concat_ws("/", F.lit(root.rstrip("/")), F.when(F.col("_day").isNull(), F.lit(unknown)).otherwise(month_folder(F.col("_day"))))
    here = dirname(F.col("src"))
    rows = rows.withColumn("dest_dir", dest)
    same = (nfc(here) == nfc("dest_dir")) if compose else (here == F.col("dest_dir"))
    return rows.withColumn("skip", same).drop("_day").select("file_id", "src", "dest_dir", "source", "skip")


def by_source(items: DataFrame) -> DataFrame:
    """A-11: how many files each kind of date decides."""
    return items.groupBy("source").agg(F.count("*").alias("n"))


def totals(items: DataFrame) -> DataFrame:
    """A-11: files to move and files that lie right."""
    return items.agg(F.coalesce(F.sum(F.when(F.col("skip"), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("to_move"), F.coalesce(F.sum(F.when(F.col("skip"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("in_place"))


def months(items: DataFrame, top: int = 12) -> DataFrame:
    """O-09: the first `top` month folders by name, and how many more there are."""
    counts = items.where("NOT skip").groupBy(basename(F.col("dest_dir")).alias("month")).agg(F.count("*").alias("n"))
    more = max(0, counts.count() - top)
    return counts.orderBy("month").limit(top).withColumn("more", F.lit(more).cast("bigint"))


def samples(items: DataFrame, top: int = 10) -> DataFrame:
    """O-10: the first moves by file id."""
    return items.where("NOT skip").orderBy("file_id").limit(top).select("file_id", basename(F.col("src")).alias("name"), "dest_dir")


def planned_names(items: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """W-10: items (file_id, dest_dir, name) with a free `planned_name`: the n-th file of a name in a folder gets ` (n-1)` before
    its extension; taken (dest_dir, name) shifts the count by one. The move itself checks once more."""
    order = F.row_number().over(Window.partitionBy("dest_dir", "name").orderBy("file_id")) - 1
    if taken is not None:
        there = taken.select("dest_dir", "name").distinct().withColumn("_taken", F.lit(1))
        items = items.join(there, ["dest_dir", "name"], "left")
        order = order + F.coalesce("_taken", F.lit(0))
    rows = items.withColumn("_n", order)
    bare = stem(F.col("name"))
    suffix = F.substring(F.col("name"), F.length(bare) + 1, F.length("name"))
    named = F.when(F.col("_n") == 0, F.col("name")).otherwise(F.concat(bare, F.format_string(" (%d)", F.col("_n").cast("int")), suffix))
    return rows.withColumn("planned_name", named).drop("_n", "_taken")
