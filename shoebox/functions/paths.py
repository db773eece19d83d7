"""Path and text columns (F-05 to F-14, P-07, S-02, S-03)."""

from __future__ import annotations

import ntpath
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a scan takes in, and system folders that it leaves out.
RASTER = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp")
HEIF = (".heic", ".heif")
RAW = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2", ".pef", ".srw")
SUPPORTED = RASTER + HEIF + RAW
SYSTEM_FOLDERS = {
    "darwin": (".Spotlight-V100", ".Trashes", ".fseventsd", ".DocumentRevisions-V100", ".TemporaryItems", ".apdisk"),
    "win32": ("$RECYCLE.BIN", "System Volume Information"),
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """F-05: the lower-case extension with its dot; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def format_of(path: Column) -> Column:
    """F-06: the extension without its dot."""
    return F.ltrim(extension(path), F.lit("."))


def stem(name: Column) -> Column:
    """F-14: a file name without its extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_supported(path: Column) -> Column:
    """S-02."""
    return extension(path).isin(*SUPPORTED)


def in_system_folder(path: Column, platform: str) -> Column:
    """S-03: whether any folder of the path is one that scans leave out on that platform."""
    names = SYSTEM_FOLDERS.get(platform, ())
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(dirname(path), "/"), F.array(*[F.lit(n) for n in names]))


def under_root(path: Column, root: str) -> Column:
    """P-07: the root itself or something below it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """F-08: Unicode composition; ASCII passes untouched. Spark has no built-in for it."""
    return F.pandas_udf(_compose, StringType())(text)


def human_size(n: Column) -> Column:
    """F-10: B, KB, MB, GB, halves to even; nothing or zero is a dash."""
    n = n.cast("double")
    return (
        F.when(n.isNull() | (n == 0), "-")
        .when(n < 1024, F.format_string("%.0f B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(n / 1024**3, 1)))
    )


def with_confidence(category: Column, confidence: Column) -> Column:
    """F-11: the category, with its confidence where there is one."""
    return F.when(F.coalesce(category, F.lit("")) != "", F.when(confidence.isNull(), category).otherwise(F.format_string("%s (신뢰도 %.2f)", category, confidence)))


def error_text(message: Column) -> Column:
    """F-12: at most 200 characters."""
    return F.substring(message, 1, 200)


def short_hash(digest: Column) -> Column:
    """F-13."""
    return F.substring(digest, 1, 12)


def long_path(path: str, platform: str) -> str:
    r"""F-09: on Windows a path that is 260 characters or longer once it is absolute gets, in that form, the \\?\ prefix (\\?\UNC\ for
    a share)."""
    if platform != "win32" or path.startswith("\\\\?\\"):
        return path
    whole = ntpath.abspath(path)
    if len(whole) < 260:
        return path
    return "\\\\?\\UNC\\" + whole[2:] if whole.startswith("\\\\") else "\\\\?\\" + whole
