"""Moving files: trash, quarantine, organise, undo (M-09 to M-13, W-10, U-06). What to do is a DataFrame plan; the file operations
run on the driver, one row at a time from toLocalIterator(), and are journalled every FLUSH files and at the end, interrupted or not.
A journal entry is a small part appended to the log; the file table is written once, at the end. Should the driver die between,
:func:`recover` brings the file table up to the log."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, organize, protect, reports
from ..operators.scratch import materialise
from ..sources.store import Store

FLUSH = 200


def free_name(folder: str, name: str) -> str:
    """W-10: the name, or the first of `name (1)`, `name (2)`... that is free."""
    base, ext = os.path.splitext(name)
    path, n = os.path.join(folder, name), 0
    while os.path.lexists(path):
        n += 1
        path = os.path.join(folder, f"{base} ({n}){ext}")
    return path


def _ids(store: Store, ids: list[int]) -> DataFrame:
    return store.spark.createDataFrame([(int(i),) for i in ids], "id bigint")


def _remove(store: Store, ids: list[int], action: str, act: Callable[[str], str | None]) -> tuple[int, int, int]:
    """(done, failed, protected): act on each requested file that isn't the last of its group."""
    request = _ids(store, ids)
    kept = protect.protected_survivors(store.read("duplicate_groups"), store.read("similar_groups"), store.read("files"), request)
    todo = reports.paths_for(store.read("files"), protect.targets(request, kept)).orderBy("id")
    batch, done, failed, log = store.next_batch(), [], 0, []

    def journal() -> None:
        store.record_actions(batch, log)
        log.clear()

    total = 0
    try:
        for row in todo.toLocalIterator():
            try:
                to = act(row["path"])
            except OSError:
                failed += 1
                continue
            total += 1
            log.append((row["id"], action, row["path"], to))
            done.append(row["id"])
            if len(log) >= FLUSH:
                journal()
    finally:
        journal()
        if done:
            store.write("files", merge.set_flag(store.read("files"), _ids(store, done), "removed"))
    return total, failed, len(set(ids)) - total - failed


def trash(store: Store, ids: list[int], send: Callable[[str], None]) -> tuple[int, int, int]:
    """M-09: send is what hands a file to the system's trash."""
    return _remove(store, ids, "trash", lambda p: send(p))


def quarantine(store: Store, ids: list[int], folder: str) -> tuple[int, int, int]:
    """M-10."""
    os.makedirs(folder, exist_ok=True)

    def act(path: str) -> str:
        to = free_name(folder, os.path.basename(path))
        shutil.move(path, to)
        return to

    return _remove(store, ids, "quarantine", act)


def _repath(store: Store, moved: list[tuple[int, str]], files: DataFrame | None = None) -> int:
    """M-05 on the stored tables, in one commit; the number of conflicts."""
    moves = store.spark.createDataFrame([(i, p, n) for n, (i, p) in enumerate(moved)], "id bigint, new_path string, seq bigint")
    files = store.read("files") if files is None else files
    judged = materialise(merge.path_updates(files, moves), "judged")
    out, left = merge.apply_path_updates(files, judged, {t: store.read(t) for t in ("duplicate_groups", "similar_groups", "action_log")})
    counts = {r["outcome"]: r["count"] for r in judged.groupBy("outcome").count().collect()}
    store.write_all({"files": out} | (left if counts.get("replaces") else {}))
    return counts.get("conflict", 0)


def recover(store: Store) -> int:
    """The file table as the log's last batch leaves it: files trashed or put in quarantine are removed, moved ones have
    their new path. For a library whose driver died between the log and the file table; a second call changes nothing. The
    number of log entries that were behind."""
    log, files = store.read("action_log"), store.read("files")
    last = log.agg(F.max("batch")).first()[0]
    rows = reports.in_batch(log, last).join(files.select(F.col("id").alias("file_id"), "path", "removed"), "file_id") if last is not None else None
    if rows is None:
        return 0
    gone = [r["file_id"] for r in rows.where("action IN ('trash', 'quarantine') AND NOT removed").select("file_id").toLocalIterator()]
    moved = [(r["file_id"], r["to_path"]) for r in rows.where("action = 'move' AND path = from_path").orderBy("id").select("file_id", "to_path").toLocalIterator()]
    if gone:
        files = merge.set_flag(files, _ids(store, gone), "removed")
    if moved:
        _repath(store, moved, files)
    elif gone:
        store.write("files", files)
    return len(gone) + len(moved)


def apply_plan(store: Store, plan: DataFrame) -> tuple[int, int, int, int]:
    """M-13: (moved, skipped, failed, stale). A file that isn't there, or that this run itself has just put there, fails."""
    batch, log, moved, made = store.next_batch(), [], [], set()
    counts = {"moved": 0, "skipped": 0, "failed": 0, "stale": 0}

    def journal() -> None:
        store.record_actions(batch, log)
        log.clear()

    try:
        for row in plan.orderBy("file_id").toLocalIterator():
            if row["skip"]:
                counts["skipped"] += 1
                continue
            try:
                if row["src"] in made or not os.path.isfile(row["src"]):
                    raise FileNotFoundError(row["src"])
                os.makedirs(row["dest_dir"], exist_ok=True)
                to = free_name(row["dest_dir"], os.path.basename(row["src"]))
                shutil.move(row["src"], to)
            except OSError:
                counts["failed"] += 1
                continue
            made.add(to)
            counts["moved"] += 1
            moved.append((row["file_id"], to))
            log.append((row["file_id"], "move", row["src"], to))
            if len(log) >= FLUSH:
                journal()
    finally:
        journal()
        if moved:
            counts["stale"] = _repath(store, moved)
    return tuple(counts.values())


def undo_last(store: Store) -> int:
    """M-11: put back the files of the last batch of quarantines or moves; those that are gone are passed over."""
    log = store.read("action_log")
    batch = reports.last_undoable(log).first()["batch"]
    if batch is None:
        return 0
    restored, paths, shown = 0, [], []

    try:
        for row in reports.undoable(reports.in_batch(log, batch)).orderBy(F.desc("id")).toLocalIterator():
            if not row["to_path"] or not os.path.lexists(row["to_path"]):
                continue
            try:
                os.makedirs(os.path.dirname(row["from_path"]), exist_ok=True)
                back = free_name(os.path.dirname(row["from_path"]), os.path.basename(row["from_path"]))
                shutil.move(row["to_path"], back)
            except OSError:
                continue
            restored += 1
            if row["action"] == "quarantine":
                shown.append(row["file_id"])
            if row["action"] == "move" or back != row["from_path"]:
                paths.append((row["file_id"], back))
    finally:  # one commit each: files shown again and their paths
        files = store.read("files")
        if shown:
            files = merge.set_flag(files, _ids(store, shown), "removed", False)
        if paths:
            _repath(store, paths, files)
        elif shown:
            store.write("files", files)
    store.write("action_log", merge.mark_undone(store.read("action_log"), batch))
    return restored


def organize_plan(store: Store, root: str, unknown: str = organize.UNKNOWN_FOLDER) -> DataFrame:
    return organize.plan(store.read("files"), os.path.abspath(root), unknown)
