"""Tables of a media library as Spark schemas, column defaults and the visibility rule (P-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"BIGINT": LongType(), "STRING": StringType(), "DOUBLE": DoubleType(), "BOOLEAN": BooleanType()}


def struct(columns: str) -> StructType:
    """A schema from `name TYPE, ...`, without a running session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


FILES = struct(
    "id BIGINT, path STRING, size BIGINT, mtime DOUBLE, format STRING, content_hash STRING, phash STRING, dhash STRING,"
    " thumb_path STRING, category STRING, category_confidence DOUBLE, scan_status STRING, error_msg STRING,"
    " missing BOOLEAN, exif_dt DOUBLE, removed BOOLEAN"
)
DUPLICATE_GROUPS = struct("group_id BIGINT, file_id BIGINT, is_representative BOOLEAN")
SIMILAR_GROUPS = struct("group_id BIGINT, file_id BIGINT, similarity_score DOUBLE, quality_score DOUBLE, is_best_shot BOOLEAN, quality_detail STRING")
SESSIONS = struct("id BIGINT, root_path STRING, started_at DOUBLE, finished_at DOUBLE, total BIGINT, processed BIGINT, status STRING")
ACTION_LOG = struct("id BIGINT, file_id BIGINT, action STRING, from_path STRING, to_path STRING, timestamp DOUBLE, batch BIGINT, undone BOOLEAN")
TABLES = {"files": FILES, "duplicate_groups": DUPLICATE_GROUPS, "similar_groups": SIMILAR_GROUPS, "scan_sessions": SESSIONS, "action_log": ACTION_LOG}
DEFAULTS = {"scan_status": "discovered", "missing": False, "removed": False, "undone": False, "is_representative": False, "is_best_shot": False}

#: Columns that a change of content makes void.
DERIVED = ("content_hash", "phash", "dhash", "thumb_path", "category", "category_confidence", "error_msg", "exif_dt")


def is_active() -> Column:
    return ~F.coalesce(F.col("removed"), F.lit(False)) & ~F.coalesce(F.col("missing"), F.lit(False))


def active(files: DataFrame) -> DataFrame:
    """P-01: rows that are neither removed nor missing."""
    return files.where(is_active())


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """M-07: missing columns are added with their defaults, types are cast, nulls of defaulted columns filled."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in have else F.lit(None)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)
