"""A library on disk (S-12, K-01 to K-07, K-12 to K-15): each table is a list of Parquet parts, and a numbered commit file names
the parts of all tables. A commit is written beside the others and appears under its number by one rename; the highest
number counts. So a broken write changes nothing, several tables change together (K-14), and an append adds a part instead of
writing a table again (K-15). One writer at a time: a number that is taken refuses the commit."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, conform


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        """The last commit's number and the parts of each table."""
        known = self._commits()
        if not known:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{known[-1]:012d}.json"))
        try:
            return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self, table: str) -> list[str] | None:
        return self._state()[1].get(table)

    def read(self, table: str) -> DataFrame:
        """S-12: the table as of the last commit; empty where there is none. Columns of older parts are completed (M-07)."""
        parts = self.current(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        frames = [conform(self.spark.read.parquet(f"{self.root}/{table}/{name}"), TABLES[table]) for name in parts[:1]]
        if parts[1:]:  # appended parts have the schema of today
            frames.append(self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{name}" for name in parts[1:]]))
        return frames[0] if len(frames) == 1 else frames[0].unionByName(conform(frames[1], TABLES[table]))

    def _part(self, table: str, df: DataFrame) -> str:
        name = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        conform(df, TABLES[table]).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _commit(self, number: int, state: dict[str, list[str]]) -> None:
        fresh, final = (self._path(f"{self.root}/_commits/{n}") for n in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            raise RuntimeError(f"commit {number} of {self.root} is taken")

    def write_all(self, frames: dict[str, DataFrame]) -> None:
        """Replace tables together; readers see all of the old ones or all of the new ones."""
        number, state = self._state()
        self._commit(number + 1, state | {table: [self._part(table, df)] for table, df in frames.items()})

    def write(self, table: str, df: DataFrame) -> None:
        self.write_all({table: df})

    def vacuum(self) -> None:
        """Delete parts and commits that the last commit doesn't need."""
        number, state = self._state()
        for table in TABLES:
            folder = self._path(f"{self.root}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if status.getPath().getName() not in state.get(table, []):
                    self._fs.delete(status.getPath(), True)
        for old in self._commits():
            if old < number:
                self._fs.delete(self._path(f"{self.root}/_commits/{old:012d}.json"), False)

    def reset(self) -> None:
        """K-12: empty every table, together."""
        self.write_all({table: self.spark.createDataFrame([], schema) for table, schema in TABLES.items()})

    def append(self, table: str, rows: list[tuple]) -> None:
        """K-13, K-15: add a few rows, numbered after the last id, as a part of their own; for ledgers and logs."""
        last = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = self.spark.createDataFrame([(last + 1 + i, *r) for i, r in enumerate(rows)], TABLES[table]).coalesce(1)
        number, state = self._state()
        self._commit(number + 1, state | {table: [*state.get(table, []), self._part(table, new)]})

    def start_session(self, root_path: str) -> int:
        self.append("scan_sessions", [(root_path, time.time(), None, None, 0, "running")])
        return self.read("scan_sessions").agg(F.max("id")).first()[0]

    def finish_session(self, session: int, total: int, status: str = "done") -> None:
        rows = self.read("scan_sessions")
        mine = F.col("id") == session
        self.write("scan_sessions", rows.withColumn("finished_at", F.when(mine, time.time()).otherwise(F.col("finished_at"))).withColumn("total", F.when(mine, total).otherwise(F.col("total"))).withColumn("processed", F.when(mine, total).otherwise(F.col("processed"))).withColumn("status", F.when(mine, status).otherwise(F.col("status"))))

    def next_batch(self) -> int:
        """A-05."""
        return self.read("action_log").agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]

    def record_actions(self, batch: int, rows: list[tuple[int, str, str, str | None]]) -> None:
        """K-15: (file_id, action, from_path, to_path) under one batch and time."""
        if rows:
            now = time.time()
            self.append("action_log", [(f, a, src, dst, now, batch, False) for f, a, src, dst in rows])
