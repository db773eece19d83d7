"""Exact dedup through a log-structured merge index over text digests.

Every map task fills a *memtable* (digest -> ids, with the bytes of the first text). A full memtable is
flushed as one sorted run, one row for each digest, so thousands of copies met by a task leave it as one row.
Runs are dealt by digest to *compaction* tasks: each loads them into an :class:`LsmIndex`, whose sorted runs
carry Bloom filters; a merge moves only digests that another run's filter admits. The survivor of a digest
is its smallest or largest identifier. Hits are verified byte for byte: inside a memtable at once, between
runs by comparing one text of each run with the survivor's text. Should two texts share a digest, all texts
of that digest are regrouped by their bytes.

Defined results: null text = empty text; a null id ranks below every id and stays null; of repeated rows
(equal id and text) exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, ASCII_UPPER, LOWER_BYTES, NULL_ID, arrow_map, claim, ids_and_texts, materialise, read_table, real_id, spark_partitions

MEMTABLE_ROWS, MEMTABLE_BYTES = 1 << 16, 24 << 20

RUN_SCHEMA = "digest binary, run_id long, rep_id long, ids array<long>, clash boolean"
GROUP_SCHEMA = "digest binary, keep_id long, keep_run long, group_size long, n_runs long, clash boolean"


def normalise(text: bytes) -> bytes:
    return text.translate(LOWER_BYTES)


class Memtable:
    """digest -> [bytes of the first text, ids]; a hit is verified against those bytes."""

    def __init__(self, digest_bytes: int, keep: str):
        self.digest_bytes, self.best = digest_bytes, max if keep == "largest" else min
        self.clear()

    def clear(self) -> None:
        self.entries: dict[bytes, list] = {}
        self.rows = self.size = 0

    def add(self, doc_id: int, text: bytes) -> None:
        digest = hashlib.sha256(text).digest()[: self.digest_bytes]
        found = self.entries.get(digest)
        if found is None:
            self.entries[digest] = [text, [doc_id], False]
            self.size += len(text)
        else:
            found[1].append(doc_id)
            found[2] |= found[0] != text
        self.rows += 1

    def full(self) -> bool:
        return self.rows >= MEMTABLE_ROWS or self.size >= MEMTABLE_BYTES

    def flush(self, run_id: int) -> pa.RecordBatch:
        keys = sorted(self.entries)
        rows = [self.entries[k] for k in keys]
        out = pa.record_batch(
            [
                pa.array(keys, pa.binary()),
                pa.array([run_id] * len(keys), pa.int64()),
                pa.array([self.best(r[1]) for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.bool_()),
            ],
            names=["digest", "run_id", "rep_id", "ids", "clash"],
        )
        self.clear()
        return out


def _flush_runs(batches, digest_bytes: int, keep: str):
    claim("exact_dedup", lambda: None)
    table, run = Memtable(digest_bytes, keep), TaskContext.get().partitionId() << 24
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table.add(doc_id, normalise(text.encode()))
            if table.full():
                yield table.flush(run)
                run += 1
    if table.rows:
        yield table.flush(run)


class BloomFilter:
    """Ten bits a key and four probes, taken from the digest's own words."""

    def __init__(self, words: np.ndarray):
        self.bits = max(64, 10 * len(words))
        self.field = np.zeros(self.bits, bool)
        for probe in self._probes(words):
            self.field[probe] = True

    def _probes(self, words: np.ndarray):
        a, b = words[:, 0], words[:, 1] | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64) for i in range(4)]

    def admits(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), bool)
        for probe in self._probes(words):
            out &= self.field[probe]
        return out


class Run:
    """Entries sorted by digest (one for each), with a filter. Columns: digest (n x 4 words), id, run, count, runs, clash."""

    def __init__(self, words, columns):
        self.words, self.columns = words, columns
        self.filter = BloomFilter(words)

    def __len__(self):
        return len(self.words)


def _sorted_unique(words: np.ndarray, columns: list[np.ndarray], largest: bool):
    """Sort by digest, then best id first (ties: lowest run), and fold equal digests."""
    ids, runs, counts, n_runs, clash = columns
    order = np.lexsort((runs, ~ids if largest else ids, *words.T[::-1]))
    words, ids, runs, counts, n_runs, clash = words[order], ids[order], runs[order], counts[order], n_runs[order], clash[order]
    if not len(words):
        return words, [ids, runs, counts, n_runs, clash]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
    return words[first], [ids[first], runs[first], np.add.reduceat(counts, first), np.add.reduceat(n_runs, first), np.maximum.reduceat(clash, first)]


class LsmIndex:
    """Memtable of unsorted entries, tiers of sorted runs, size-tiered compaction of `fan` runs at a time."""

    def __init__(self, largest: bool, memtable: int = 1 << 15, fan: int = 4):
        self.largest, self.memtable, self.fan = largest, memtable, fan
        self.pending: list = []
        self.rows = 0
        self.tiers: list[list[Run]] = []

    def put(self, words: np.ndarray, columns: list[np.ndarray]) -> None:
        self.pending.append((words, columns))
        self.rows += len(words)
        if self.rows >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            words = np.concatenate([w for w, _ in self.pending])
            columns = [np.concatenate(c) for c in zip(*(c for _, c in self.pending))]
            self.pending, self.rows = [], 0
            self._push(Run(*_sorted_unique(words, columns, self.largest)), 0)

    def _push(self, run: Run, tier: int) -> None:
        while len(self.tiers) <= tier:
            self.tiers.append([])
        self.tiers[tier].append(run)
        if len(self.tiers[tier]) >= self.fan:
            runs, self.tiers[tier] = self.tiers[tier], []
            self._push(self._merge(runs), tier + 1)

    def _merge(self, runs: list[Run]) -> Run:
        """Only entries that some other run's filter admits are folded; the rest can't have a partner."""
        hits = []
        for i, run in enumerate(runs):
            maybe = np.zeros(len(run), bool)
            for j, other in enumerate(runs):
                if i != j:
                    maybe |= other.filter.admits(run.words)
            hits.append(maybe)
        words = np.concatenate([r.words[h] for r, h in zip(runs, hits)])
        columns = [np.concatenate([r.columns[k][h] for r, h in zip(runs, hits)]) for k in range(5)]
        words, columns = _sorted_unique(words, columns, self.largest)
        words = np.concatenate([words, *(r.words[~h] for r, h in zip(runs, hits))])
        columns = [np.concatenate([columns[k], *(r.columns[k][~h] for r, h in zip(runs, hits))]) for k in range(5)]
        order = np.lexsort(words.T[::-1])
        return Run(words[order], [c[order] for c in columns])

    def compact(self) -> Run | None:
        self.flush()
        runs = [r for tier in self.tiers for r in tier]
        self.tiers = []
        return None if not runs else runs[0] if len(runs) == 1 else self._merge(runs)


def _digest_words(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    out = np.zeros((len(column), 32), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(">u8").astype(np.uint64)


def _compact(batches, width: int, largest: bool):
    index = LsmIndex(largest)
    for batch in batches:
        if batch.num_rows:
            ids, runs, counts, clash = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            index.put(_digest_words(batch.column(0), width), [ids, runs, counts, np.ones(len(ids), np.int64), clash.astype(bool)])
    run = index.compact()
    if run is not None:
        raw = run.words.astype(">u8").view(np.uint8).reshape(len(run), 32)[:, :width].tobytes()
        ids, runs, counts, n_runs, clash = run.columns
        for at in range(0, len(run), 1 << 14):
            to = min(len(run), at + (1 << 14))
            digests = [raw[i * width : (i + 1) * width] for i in range(at, to)]
            yield pa.record_batch([pa.array(digests, pa.binary()), *(pa.array(c[at:to]) for c in (ids, runs, counts, n_runs, clash))], names=["digest", "keep_id", "keep_run", "group_size", "n_runs", "clash"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep: which identifier of equal texts stays. digest_bytes: shorter digests collide (tests); results stay exact.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    source = ids_and_texts(docs, id_col, text_col)
    runs = materialise(arrow_map(source, partial(_flush_runs, digest_bytes=digest_bytes, keep=keep), RUN_SCHEMA), "dedup-runs")
    n = spark_partitions(docs.sparkSession)
    light = runs.select("digest", "rep_id", "run_id", F.size("ids").cast("long").alias("n"), "clash").repartition(n, "digest")
    groups = materialise(arrow_map(light, partial(_compact, width=digest_bytes, largest=keep == "largest"), GROUP_SCHEMA), "dedup-groups")
    clashing = _verify(source, runs, groups)
    rows = (
        runs.select("digest", "run_id", "ids")
        .join(groups.select("digest", "keep_id", "keep_run", "group_size"), "digest")
        .select("*", (F.array_position("ids", F.col("keep_id")) - 1).alias("keep_pos"), F.posexplode("ids").alias("pos", "doc_id"))
        .withColumn("kept", (F.col("run_id") == F.col("keep_run")) & (F.col("pos") == F.col("keep_pos")))
    )
    exact = digest_bytes == 32
    out = rows.select(real_id().alias("doc_id"), real_id("keep_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "digest")
    if clashing is not None:
        again = _regroup(source, clashing, digest_bytes, keep)
        out = out.join(clashing, "digest", "left_anti").drop("digest").unionByName(again)
    elif not exact:
        whole = source.select(F.substring(F.unhex(F.sha2(_norm(), 256)), 1, digest_bytes).alias("digest"), F.sha2(_norm(), 256).alias("text_sha256")).distinct()
        out = out.drop("text_sha256").join(whole, "digest").drop("digest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _norm():
    return F.translate("text", ASCII_UPPER, ASCII_LOWER)


def _verify(source: DataFrame, runs: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Digests under which texts differ, or None. One text of each run meets the survivor's text."""
    several = groups.where("n_runs > 1").select("digest", "keep_id", "keep_run")
    reps = runs.select("digest", "run_id", "rep_id").join(several, "digest").withColumn("is_keep", F.col("run_id") == F.col("keep_run"))
    texts = reps.join(source.withColumn("digest_of", F.unhex(F.sha2(_norm(), 256))), (F.col("rep_id") == F.col("doc_id")) & F.startswith("digest_of", "digest")).select("digest", "is_keep", _norm().alias("norm"))
    keeper = texts.where("is_keep").select("digest", F.col("norm").alias("keep_norm"))
    differs = texts.where("NOT is_keep").join(keeper, "digest").where("norm <> keep_norm").select("digest")
    bad = materialise(differs.union(groups.where("clash").select("digest")).distinct(), "dedup-clashes")
    return None if bad.isEmpty() else bad


def _regroup(source: DataFrame, clashing: DataFrame, digest_bytes: int, keep: str) -> DataFrame:
    """Texts of clashing digests, grouped by their whole bytes."""
    rows = source.withColumn("norm", _norm()).withColumn("digest", F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes)).join(clashing, "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows.select("doc_id", "norm", "uid"), "dedup-regroup")
    best = F.max_by if keep == "largest" else F.min_by
    groups = rows.groupBy("norm").agg(F.count("*").alias("group_size"), best(F.struct("doc_id", "uid"), F.struct("doc_id", "uid")).alias("best"))
    return rows.join(groups, "norm").select(real_id().alias("doc_id"), F.when(F.col("best.doc_id") != NULL_ID, F.col("best.doc_id")).alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


SQL = {
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
