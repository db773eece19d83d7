"""Shared plumbing of the corpus operators: Arrow mapping, scratch tables, ASCII word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import checkpoint_root, materialise  # noqa: F401

#: Rows and bytes of one Arrow batch handed to Python; long texts make the byte bound the one that counts.
BATCH_ROWS, BATCH_BYTES = "2000", str(4 << 20)

#: Stands for a null id inside an operator: it sorts below every real id and is turned back at the end.
NULL_ID = -(1 << 63)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches small enough that rows of very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_owner: list = [None, None]


def claim(name: str, release: Callable[[], None]) -> None:
    """What an operator remembers in a Python worker goes when another operator's task begins there: workers are
    reused, and the memos of several operators together would outgrow them."""
    if _owner[0] != name:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = [name, release]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others) -> DataFrame:
    """(doc_id, text) with a null id as NULL_ID and a null text as the empty text; every column but `others` goes."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *others,
    )


def real_id(col: str = "doc_id"):
    """NULL_ID back to null."""
    return F.when(F.col(col) != NULL_ID, F.col(col))
