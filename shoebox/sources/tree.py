"""A directory tree as a table (S-01 to S-05), by Spark's Python data source API.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").load("/photos")      # path, size, mtime, format

Hidden names and empty files are listed, symlinks aren't followed, folders that can't be read are passed over, and no
file is opened. Folders are split among partitions: the walk opens levels until there are enough of them.
"""

from __future__ import annotations

import hashlib
import os
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import SUPPORTED, SYSTEM_FOLDERS

SPLITS = 64


class _Folders(InputPartition):
    def __init__(self, folders: list[str], recurse: bool):
        self.folders, self.recurse = folders, recurse


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.skip = set(SYSTEM_FOLDERS.get(options.get("platform", sys.platform), ()))
        self.any = str(options.get("alltypes", "false")).lower() == "true"

    def _list(self, folder: str):
        """(folders, files) of one folder; entries that fail are passed over."""
        folders, files = [], []
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if e.name not in self.skip:
                                folders.append(e.path)
                        elif e.is_file(follow_symlinks=False) and (self.any or os.path.splitext(e.name)[1].lower() in SUPPORTED):
                            s = e.stat(follow_symlinks=False)
                            files.append((unicodedata.normalize("NFC", e.path), s.st_size, s.st_mtime, os.path.splitext(e.name)[1].lower()[1:]))
                    except OSError:
                        continue
        except OSError:
            pass
        return folders, files

    def partitions(self):
        """Levels are opened on the driver until there are SPLITS folders; their own files are one partition."""
        opened, level = [], [self.root]
        while level and len(level) < SPLITS and len(opened) < SPLITS:
            opened += level
            level = [f for folder in level for f in self._list(folder)[0]]
        dealt = [level[i::SPLITS] for i in range(SPLITS) if level[i::SPLITS]]
        return [_Folders(opened, False), *(_Folders(d, True) for d in dealt)]

    def read(self, partition):
        stack = list(partition.folders)
        while stack:
            folders, files = self._list(stack.pop())
            if partition.recurse:
                stack += folders
            yield from files


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, size bigint, mtime double, format string"

    def reader(self, schema):
        return TreeReader(self.options)


def walk(spark: SparkSession, root: str, platform: str | None = None, all_types: bool = False) -> DataFrame:
    """S-01 to S-03: the supported files below root."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("platform", platform or sys.platform).option("alltypes", str(all_types)).load(root)


def _digest(path: str, limit: int | None) -> str | None:
    try:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            if limit is not None:
                h.update(f.read(limit))
            else:
                while block := f.read(1 << 20):
                    h.update(block)
        return h.hexdigest()
    except OSError:
        return None


def file_digest(path: Column, limit: int | None = None) -> Column:
    """S-04, S-05: SHA-256 of a file, or of its first `limit` bytes; null where it can't be read (A-17)."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: _digest(p, limit))

    return run(path)
