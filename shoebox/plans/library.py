"""The stages of a library run over a Store: scan, dedup, analyze, similar, bestshot (M-02, A-01, I-12, W-08)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import exif_epoch
from ..functions.paths import basename
from ..functions.signature import hex_to_bigint
from ..operators import bestshot, classify, dedup, features, merge, reports, similarity
from ..operators.scratch import materialise
from ..sources.images import Decoders, load_images
from ..sources.sinks import png
from ..sources.store import Store
from ..sources.tree import file_digest, walk


def scan(store: Store, root: str, deletions: bool = False) -> dict:
    """M-02, M-03: {new, updated, unchanged, deleted}; deleted is None where deletions weren't asked for or the walk met nothing."""
    root = os.path.abspath(root)
    session = store.start_session(root)
    try:
        files = store.read("files")
        seen = materialise(walk(store.spark, root), "walk")
        counts = merge.summary(merge.diff(files, seen)).first().asDict()
        after = merge.upsert(files, seen)
        if deletions:
            gone = merge.detect_deletions(files, seen, root)
            if gone is not None:
                gone = materialise(gone, "gone")
                counts["deleted"] = gone.count()
                after = merge.set_flag(after, gone, "missing")
        store.write("files", after)
        total = counts["new"] + counts["updated"] + counts["unchanged"]
        store.finish_session(session, total)
        return counts
    except BaseException:
        store.finish_session(session, 0, "error")
        raise


def _spread(files: DataFrame, workers: int | None) -> DataFrame:
    """Rows dealt to so many tasks; as they come where no number is asked for."""
    return files.repartition(workers) if workers else files


def find_duplicates(store: Store, prefilter: bool = True, workers: int | None = None) -> DataFrame:
    """A-01, K-01, K-03: groups of byte-identical active files, saved; hashed rows get their hash and status."""
    files = _spread(reports.active(store.read("files")), workers)
    found = dedup.find_duplicates(files.select("id", "path", "size"), file_digest(F.col("path"), dedup.PREFIX_BYTES), file_digest(F.col("path")), prefilter)
    groups = materialise(dedup.group_duplicates(found), "duplicates")
    store.write("duplicate_groups", groups)
    hashed = groups.select(F.col("file_id").alias("id"), "content_hash")
    store.write("files", merge.set_columns(store.read("files"), hashed, status="hashed"))
    return groups


def _write_thumbs(rows: Iterable[Row], folder: str) -> None:
    for r in rows:
        path = f"{folder}/{r['file_id']}.png"
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(png(np.frombuffer(r["thumb"], np.uint8).reshape(r["thumb_height"], r["thumb_width"], 3)))
        os.replace(f.name, path)


def analyze(store: Store, thumbs: str | None = None, cfg: Config | None = None, decoders: Decoders | None = None, workers: int | None = None) -> tuple[int, int]:
    """I-12: (ok, errors) of files that need it. Executors write thumbnails to `{thumbs}/{id}.png`, a folder that all share."""
    cfg = cfg or Config()
    pending = _spread(reports.needs_analysis(store.read("files")).select("id", "path"), workers)
    images = load_images(store.spark, pending, decoders)
    found = features.analyse_images(images, cfg.thumb_size).join(images.select("file_id", "make", "model", exif_epoch(F.col("dt_raw")).alias("exif_dt")), "file_id")
    rows = found.join(pending.select(F.col("id").alias("file_id"), basename(F.col("path")).alias("name")), "file_id")
    rows = materialise(classify.classify(rows, cfg), "analysis")
    good = rows.where("error IS NULL")
    if thumbs:
        thumbs = os.path.abspath(thumbs)
        os.makedirs(thumbs, exist_ok=True)
        good.select("file_id", "thumb", "thumb_height", "thumb_width").foreachPartition(partial(_write_thumbs, folder=thumbs))
    path = F.concat(F.lit(f"{thumbs}/"), F.col("file_id").cast("string"), F.lit(".png")) if thumbs else F.lit(None).cast("string")
    values = good.select(F.col("file_id").alias("id"), "phash", "dhash", path.alias("thumb_path"), "category", "category_confidence", "exif_dt")
    files = merge.set_columns(store.read("files"), values, status="analyzed")
    broken = rows.where("error IS NOT NULL").select(F.col("file_id").alias("id"), F.substring("error", 1, 200).alias("error_msg"))
    store.write("files", merge.set_columns(files, broken, status="error"))
    return good.count(), broken.count()


def find_similar(store: Store, cfg: Config | None = None) -> DataFrame:
    """K-02: groups of near-duplicate files, saved."""
    rows = reports.with_signature(store.read("files")).select("id", hex_to_bigint(F.col("phash")).alias("h"), "exif_dt")
    found = materialise(similarity.cluster_similar(rows, cfg), "similar")
    numbers = dedup.number_groups(found.select("component").distinct(), "component").select("component", "group_id")
    groups = materialise(found.join(numbers, "component").select("group_id", "file_id", "similarity_score"), "similar-groups")
    store.write("similar_groups", groups)
    return groups


def choose_best(store: Store, preset: str | None = None, cfg: Config | None = None, detector: Callable | None = None) -> int:
    """W-08, K-07: quality columns of all similar groups; the number of groups. Metrics come from the thumbnails."""
    groups = store.read("similar_groups")
    members = groups.join(store.read("files").select(F.col("id").alias("file_id"), "thumb_path"), "file_id")
    thumbs = members.where("thumb_path IS NOT NULL").select(F.col("file_id").alias("id"), F.col("thumb_path").alias("path"))
    pixels = load_images(store.spark, thumbs).where("data IS NOT NULL")
    q = features.analysis_quality(pixels, detector)
    scored = bestshot.best_shots(groups, q, cfg, preset)
    old = groups.drop("quality_score", "is_best_shot", "quality_detail")
    store.write("similar_groups", materialise(old.join(scored.drop("reason"), ["group_id", "file_id"]), "best"))
    return groups.select("group_id").distinct().count()


@dataclass
class LibraryRun:
    """All stages in order; a summary of eight counters. `progress` hears of each stage. Where `failed` is given it hears why a run
    broke off, whose summary is then None; otherwise the exception passes through."""

    store: Store
    root: str
    thumbs: str
    cfg: Config | None = None
    deletions: bool = True
    progress: Callable[[str], None] = lambda stage: None
    failed: Callable[[str], None] | None = None
    decoders: Decoders | None = None
    detector: Callable | None = None

    def run(self) -> dict | None:
        try:
            return self._stages()
        except Exception as e:
            if self.failed is None:
                raise
            self.failed(str(e))
            return None

    def _stages(self) -> dict:
        self.progress("scan")
        scanned = scan(self.store, self.root, self.deletions)
        self.progress("dedup")
        copies = find_duplicates(self.store)
        self.progress("analyze")
        ok, errors = analyze(self.store, self.thumbs, self.cfg, self.decoders)
        self.progress("similar")
        similar = find_similar(self.store, self.cfg)
        self.progress("bestshot")
        best = choose_best(self.store, cfg=self.cfg, detector=self.detector)
        count = lambda df: df.select("group_id").distinct().count()
        return {
            "scanned_new": scanned["new"], "scanned_updated": scanned["updated"], "scanned_deleted": scanned["deleted"], "analyzed_ok": ok,
            "analyzed_err": errors, "duplicate_groups": count(copies), "similar_groups": count(similar), "bestshot_groups": best,
        }
