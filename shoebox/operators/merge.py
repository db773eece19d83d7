"""Snapshot merge: upsert, deletion diff, flags, path updates, NFC migration (M-01 to M-08, J-07, J-11, J-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import nfc, under_root
from ..schema import DERIVED, FILES, conform, is_active
from .scratch import materialise


def diff(files: DataFrame, seen: DataFrame) -> DataFrame:
    """M-01: (path, status, ...) of what a walk saw (path, size, mtime, format): new, unchanged or updated."""
    old = files.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), "unchanged").otherwise("updated")
    return seen.dropDuplicates(["path"]).join(old, "path", "left").withColumn("status", status).drop("known")


def upsert(files: DataFrame, seen: DataFrame) -> DataFrame:
    """M-01: the next snapshot. New paths get ids after the largest one, in path order; changed files lose what was derived
    from their bytes and are discovered again; whatever was seen isn't missing. `removed` stays."""
    files = conform(files, FILES)
    changes = diff(files, seen).select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"), F.col("format").alias("new_format"), "status")
    old = files.join(changes.where("status <> 'new'"), "path", "left")
    changed = F.coalesce(F.col("status") == "updated", F.lit(False))
    kept = old.select(
        *[
            F.when(changed, F.lit(None)).otherwise(F.col(c)).alias(c) if c in DERIVED
            else F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in ("size", "mtime", "format")
            else F.when(changed, F.lit("discovered")).otherwise(F.col(c)).alias(c) if c == "scan_status"
            else F.when(F.col("status").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "missing"
            else F.col(c)
            for c in files.columns
        ]
    )
    from .dedup import number_groups

    last = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = number_groups(changes.where("status = 'new'"), "path")
    fresh = fresh.select((F.lit(last) + F.col("group_id")).alias("id"), "path", F.col("new_size").alias("size"), F.col("new_mtime").alias("mtime"), F.col("new_format").alias("format"))
    return conform(kept, FILES).unionByName(conform(fresh, FILES))


def summary(changes: DataFrame, deleted: int | None = None) -> DataFrame:
    """A-12: one row of counts."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(s)
    return changes.agg(count("new"), count("updated"), count("unchanged")).withColumn("deleted", F.lit(deleted).cast("bigint"))


def vanished(files: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """J-07, U-03: active known paths under the root that the walk didn't meet."""
    known = files.where(is_active() & under_root(F.col("path"), root)).select("id", "path")
    return known.join(seen.select("path"), "path", "left_anti")


def detect_deletions(files: DataFrame, seen: DataFrame, root: str) -> DataFrame | None:
    """M-03: vanished(), or None where the walk met nothing at all: a root that isn't mounted deletes nothing."""
    return None if seen.isEmpty() else vanished(files, seen, root)


def set_flag(files: DataFrame, ids: DataFrame, flag: str, value: bool = True) -> DataFrame:
    """M-04: set missing or removed for the ids (column id)."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, "id", "left").withColumn(flag, F.when(F.col("_hit"), value).otherwise(F.col(flag))).drop("_hit").select(*files.columns)


def path_updates(files: DataFrame, moves: DataFrame) -> DataFrame:
    """M-05, J-13: moves (id, new_path, seq) judged in the order of seq: `moved`, `replaces` (a dead row holds the path) or `conflict` (a
    live one does, or an earlier move of the batch has gone there). A file moves at most once in a batch, and one that has
    moved away earlier, itself without a conflict, holds its path no more.

    Of the moves to a path only one can succeed: the first after its live holder's own move. It does if that one did, which
    in turn may wait for another; such chains are settled by doubling, in rounds that grow with the logarithm of the longest.
    """
    holders = files.select(F.col("path").alias("new_path"), F.col("id").alias("holder"), (~is_active()).alias("dead"))
    leaves = moves.select(F.col("id").alias("holder"), F.col("seq").alias("left_at"))
    rows = moves.join(holders, "new_path", "left").join(leaves, "holder", "left")
    rows = rows.withColumn("other", F.col("holder").isNotNull() & (F.col("holder") != F.col("id")))
    rows = rows.withColumn("waits", F.coalesce(F.col("other") & (F.col("left_at") < F.col("seq")), F.lit(False)))
    may = ~F.col("other") | F.col("dead") | F.col("waits")
    first = F.row_number().over(Window.partitionBy("new_path", may).orderBy("seq")) == 1
    rows = materialise(rows.withColumn("ok", may & first), "moves")
    state = rows.select("id", "ok", F.when(F.col("waits") & ~F.col("dead"), F.col("holder")).alias("on"))
    while not state.where("ok AND on IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("on"), F.col("ok").alias("_ok"), F.col("on").alias("_on"))
        state = state.join(above, "on", "left").select("id", (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), F.col("_on").alias("on"))
        state = materialise(state, "moves")
    gone = state.select(F.col("id").alias("holder"), F.col("ok").alias("_gone"))
    judged = rows.drop("ok").join(state.select("id", "ok"), "id").join(gone, "holder", "left")
    dropped = F.when(F.col("ok") & F.col("other") & F.col("dead") & ~(F.col("waits") & F.coalesce("_gone", F.lit(False))), F.col("holder"))
    outcome = F.when(~F.col("ok"), "conflict").when(dropped.isNotNull(), "replaces").otherwise("moved")
    return judged.select("id", "new_path", outcome.alias("outcome"), dropped.alias("dropped"))


def apply_path_updates(files: DataFrame, judged: DataFrame, dependents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The snapshot after path_updates(), and its dependent tables without rows of replaced files."""
    gone = judged.where("outcome = 'replaces'").select(F.col("dropped").alias("id")).where("id IS NOT NULL").distinct()
    moved = judged.where("outcome <> 'conflict'").select("id", "new_path")
    out = files.join(gone, "id", "left_anti").join(moved, "id", "left").withColumn("path", F.coalesce("new_path", "path")).select(*files.columns)
    left = {k: t.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti") for k, t in (dependents or {}).items()}
    return out, left


def migrate_nfc(files: DataFrame, dependents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """M-06: composed paths; of rows that become one path the composed one stays (else the one of the largest id), the others go
    with what depends on them."""
    rows = files.withColumn("_nfc", nfc("path"))
    order = Window.partitionBy("_nfc").orderBy(F.desc(F.col("path") == F.col("_nfc")), F.desc("id"))
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    gone = ranked.where("_rank > 1").select("id")
    out = ranked.where("_rank = 1").withColumn("path", F.col("_nfc")).select(*files.columns)
    left = {k: t.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti") for k, t in (dependents or {}).items()}
    return out, left


def mark_undone(log: DataFrame, batch: int) -> DataFrame:
    """M-08."""
    return log.withColumn("undone", F.when(F.col("batch") == batch, True).otherwise(F.col("undone")))


def set_columns(files: DataFrame, values: DataFrame, status: str | None = None, key: str = "id") -> DataFrame:
    """K-03 to K-06: overwrite columns by key where `values` has a row and the value isn't null."""
    columns = [c for c in values.columns if c != key and c in files.columns]
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = files.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    if status:
        out = out.withColumn("scan_status", F.when(F.col("_hit"), status).otherwise(F.col("scan_status")))
    return out.select(*files.columns)
