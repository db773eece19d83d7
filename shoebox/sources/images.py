"""Decoded images (S-06 to S-11): Spark's image source over links named by file id, plug-in decoders for other formats, with
EXIF beside the pixels."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import RAW, extension
from ..operators.scratch import checkpoint_root
from .exif import exif

#: Optional plug-ins (S-08, S-09), extension -> function(path) giving (height, width, RGB bytes) or None. They travel with the job.
Decoders = Mapping[str, Callable[[str], "tuple[int, int, bytes] | None"]]
PIXELS = "file_id bigint, height int, width int, nChannels int, data binary"
LINKS_A_FOLDER = 4096


def _link(rows: Iterable[Row], folder: str) -> None:
    for row in rows:
        part = f"{folder}/{row['id'] // LINKS_A_FOLDER}"
        os.makedirs(part, exist_ok=True)
        try:
            os.symlink(row["path"], f"{part}/{row['id']}{row['ext']}")
        except FileExistsError:  # a task that runs again
            pass


def stage_links(files: DataFrame) -> str:
    """A folder of links `{id}{extension}` to the files, made by the executors in the shared scratch folder: the image source skips
    hidden names and returns encoded paths, neither of which matters to these. It goes when the driver ends."""
    spark = files.sparkSession
    root = urlparse(checkpoint_root(spark))
    if root.scheme not in ("", "file"):
        raise RuntimeError("links to images need spark.checkpoint.dir on a mounted file system")
    folder = f"{root.path}/links-{uuid.uuid4().hex}"
    os.makedirs(folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    files.select("id", "path", extension(F.col("path")).alias("ext")).foreachPartition(partial(_link, folder=folder))
    return folder


def _plugged(batches: Iterable[pd.DataFrame], decoders: Decoders) -> Iterable[pd.DataFrame]:
    """One frame for each image, so that a batch of paths never holds many images at once. What fails is a row without pixels."""
    for batch in batches:
        for file_id, path, ext in zip(batch["id"], batch["path"], batch["ext"]):
            row = (file_id, -1, -1, -1, None)
            try:
                got = decoders[ext](path)
                if got is not None:
                    height, width, data = got
                    bgr = np.frombuffer(data, np.uint8).reshape(height, width, 3)[:, :, ::-1]
                    row = (file_id, height, width, 3, bgr.tobytes())
            except Exception:  # noqa: BLE001
                pass
            yield pd.DataFrame([row], columns=["file_id", "height", "width", "nChannels", "data"])


def load_images(spark: SparkSession, files: DataFrame, decoders: Decoders | None = None) -> DataFrame:
    """S-06 to S-09: (file_id, height, width, nChannels, data, make, model, dt_raw, orientation) for every row of files (id,
    path); what can't be decoded has null data. RAW files give make RAW and no time. Files whose extension has a decoder are read by it."""
    found = spark.createDataFrame([], PIXELS)
    own = extension(F.col("path")).isin(*(decoders or {}))
    native = files.where(~F.coalesce(own, F.lit(False)))
    if not native.isEmpty():
        source = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(stage_links(native))
        file_id = F.regexp_extract(F.col("image.origin"), r"/(\d+)\.?[^/]*$", 1).cast("bigint")
        found = source.select(file_id.alias("file_id"), "image.height", "image.width", "image.nChannels", F.when(F.col("image.height") > 0, F.col("image.data")).alias("data"))
    if decoders:
        rows = files.where(own).select("id", "path", extension(F.col("path")).alias("ext"))
        found = found.unionByName(rows.mapInPandas(partial(_plugged, decoders=dict(decoders)), PIXELS))
    raw = extension(F.col("path")).isin(*RAW)
    meta = files.select(F.col("id").alias("file_id"), raw.alias("_raw"), F.when(~raw, F.col("path")).alias("_path")).withColumn("_exif", exif(F.col("_path")))
    meta = meta.select("file_id", F.when(F.col("_raw"), "RAW").otherwise(F.col("_exif.make")).alias("make"), "_exif.model", "_exif.dt_raw", "_exif.orientation")
    return meta.join(found, "file_id", "left")


def exif_summary(spark: SparkSession, files: DataFrame, decoders: Decoders | None = None) -> DataFrame:
    """S-10: (file_id, width, height, make, model, datetime); all null for RAW."""
    rows = load_images(spark, files, decoders)
    raw = F.coalesce(F.col("make") == "RAW", F.lit(False))
    pick = lambda c, name: F.when(~raw, F.col(c)).alias(name)
    return rows.select("file_id", F.when(~raw & (F.col("width") > 0), F.col("width")).alias("width"), F.when(~raw & (F.col("height") > 0), F.col("height")).alias("height"), pick("make", "make"), pick("model", "model"), pick("dt_raw", "datetime"))
