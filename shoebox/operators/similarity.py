"""Near-duplicate signatures: banded Hamming join (J-05), burst join (J-06), clusters (G-02)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.signature import band_key, band_layout, hamming
from .graph import connected_components
from .scratch import materialise

ROW_COST = 2
BLOCK = 1 << 16  # signatures that a task compares with each other, or with another block
STEP = 32  # signatures compared with a whole block at once
DENSE_SHARE = 1 / 40  # a joined candidate costs about 20 times a pair that is compared in a block


def hamming_pairs(entries: DataFrame, threshold: int, bits: int = 64, near: int = 0) -> DataFrame:
    """J-05: (a, b, distance) of entries (id, h) at most `threshold` bits apart, a < b, each pair once.

    With threshold // (near + 1) + 1 bands two such signatures differ by at most `near` bits in one band at least. So one side offers its
    key of each band and the other asks for that key and, where near is 1, for all keys one bit away: an equi-join by (band, key) that
    misses nothing. near = 0 sends threshold + 1 rows for an entry, near = 1 about `bits`, but its keys are twice as wide and
    candidates far fewer. A pair is kept only in its first such band: no distinct, no second shuffle. Where many entries share a signature, :func:`similar_edges` ties them together first and joins only
    different signatures.
    """
    if threshold < 0:
        return entries.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    layout = band_layout(bits, threshold // (near + 1) + 1)
    keys = [band_key(F.col("h"), s, w) for s, w in layout]
    own = F.array(*[F.struct(F.lit(i).alias("band"), k.alias("key")) for i, k in enumerate(keys)])
    flips = [[0] + [1 << b if b < 63 else -1 << 63 for b in range(w)] * near for _, w in layout]
    asked = F.array(*[F.struct(F.lit(i).alias("band"), k.bitwiseXOR(F.lit(f).cast("bigint")).alias("key")) for i, k in enumerate(keys) for f in flips[i]])
    left = entries.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.inline(asked))
    right = entries.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.inline(own))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.lit(len(layout))
    for i in reversed(range(len(layout))):
        first = F.when(F.bit_count(band_key(differ, *layout[i])) <= near, i).otherwise(first)
    distance = F.bit_count(differ)
    joined = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (distance <= threshold) & (first == F.col("band")))
    return joined.select("a", "b", distance.alias("distance"))


def cheaper_near(entries: int, threshold: int, bits: int = 64) -> int:
    """Which `near` of :func:`hamming_pairs` costs less: random keys make candidates for each entry, and a row that is
    shuffled and sorted costs about as much as ROW_COST candidates."""
    cost = lambda bands, asked: entries * bands * asked / 2 ** (bits / bands) + ROW_COST * (asked + 1) * bands
    wide = threshold // 2 + 1
    return 1 if threshold > 1 and cost(wide, 1 + bits / wide) < cost(threshold + 1, 1) else 0


def banding_helps(threshold: int, bits: int = 64) -> bool:
    """Whether the better of the two bandings makes candidates of few enough of all pairs."""
    share = lambda bands, asked: bands * asked / 2 ** (bits / bands)
    wide = threshold // 2 + 1
    return min(share(wide, 1 + bits / wide), share(threshold + 1, 1)) <= DENSE_SHARE


def _near(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= threshold


def _columns(batch, *names: str):
    return zip(*([np.asarray(row.values) for row in batch.column(n)] for n in names))


def _edge_batches(src: list, dst: list):
    if src:
        yield pa.record_batch([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=["src", "dst"])


def _forests(batches, threshold: int):
    """Rows (ids, hs), one for each block, to edges that connect what is connected in the block: stars around the smallest ids, which
    settle in few rounds. A signature is compared only with those that no component has yet, so a block of one large component
    takes far fewer comparisons than it has pairs."""
    for batch in batches:
        for ids, hs in _columns(batch, "ids", "hs"):
            src, dst, rest = [], [], np.arange(len(ids))
            while len(rest):
                waiting, rest = rest[:1], rest[1:]
                tied = [waiting]
                while len(waiting) and len(rest):
                    now, waiting = waiting[:STEP], waiting[STEP:]
                    hit = _near(hs[now], hs[rest], threshold).any(axis=0)
                    if hit.any():
                        tied.append(rest[hit])
                        waiting, rest = np.concatenate([waiting, rest[hit]]), rest[~hit]
                if len(tied) > 1:
                    of = ids[np.concatenate(tied)]
                    dst.append(of[of != of.min()])
                    src.append(np.full(len(dst[-1]), of.min()))
            yield from _edge_batches(src, dst)


def _bridges(batches, threshold: int):
    """Rows of two blocks (ids, hs, labels; ids2, hs2, labels2) to one edge for each pair of labels that near signatures tie."""
    for batch in batches:
        for ids, hs, of, ids2, hs2, of2 in _columns(batch, "ids", "hs", "labels", "ids2", "hs2", "labels2"):
            src, dst = [], []
            for at in range(0, len(ids), STEP):
                x, y = np.nonzero(_near(hs[at : at + STEP], hs2, threshold) & (of[at : at + STEP, None] != of2[None, :]))
                if len(x):
                    _, first = np.unique(np.stack([of[at + x], of2[y]]), axis=1, return_index=True)
                    src.append(ids[at + x[first]])
                    dst.append(ids2[y[first]])
            yield from _edge_batches(src, dst)


def dense_edges(entries: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Edges (src, dst) that connect what J-05 connects, for thresholds at which bands miss hardly any pair. Entries (id, h) differ in h.

    Entries are dealt into blocks twice, by different hashes, and each block is connected by itself. Where many pairs are near, that ties
    almost all entries into one component. Only what lies outside the largest component is then compared with everything, block by
    block: two entries inside need no edge of their own. With no large component that is every pair, so nothing is missed.
    """
    rows = entries.where("id IS NOT NULL AND h IS NOT NULL").select("id", "h")
    n = rows.count()
    edge = "src long, dst long"

    def dealt(turn: int) -> DataFrame:
        of = rows.groupBy(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(n // block + 1)).alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("h").alias("hs"))
        return of.select("ids", "hs").mapInArrow(lambda b: _forests(b, threshold), edge)

    if n <= block:
        return dealt(0)
    found = materialise(dealt(0).unionByName(dealt(1)), "dense-forests")
    labelled = rows.join(connected_components(found), "id", "left").select("id", "h", F.coalesce("component", "id").alias("label"))
    labelled = materialise(labelled, "dense-labels")
    largest = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()["label"]
    outside = F.col("label") != largest
    n_out = labelled.where(outside).count()
    if not n_out:
        return found
    # blocks of one side are numbered from 0, those of the other behind them
    out_blocks = n_out // block + 1
    place = F.when(outside, F.pmod(F.xxhash64("id"), F.lit(out_blocks))).otherwise(out_blocks + F.pmod(F.xxhash64("id"), F.lit((n - n_out) // block + 1)))
    blocks = labelled.groupBy(place.alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("h").alias("hs"), F.collect_list("label").alias("labels"))
    blocks = materialise(blocks, "dense-blocks")
    other = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("hs").alias("hs2"), F.col("labels").alias("labels2"))
    pairs = blocks.where(F.col("block") < out_blocks).join(other, F.col("block") <= F.col("block2"))
    pairs = pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "block2").select("ids", "hs", "labels", "ids2", "hs2", "labels2")
    return found.unionByName(pairs.mapInArrow(lambda b: _bridges(b, threshold), edge))


def similar_edges(entries: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """Edges (src, dst) that connect what J-05 connects: equal signatures are tied to their smallest id, and only
    different signatures are joined, by bands where these help."""
    firsts = materialise(entries.groupBy("h").agg(F.min("id").alias("first")), "signatures")
    star = entries.join(firsts, "h").where("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    if threshold < 0:
        return star.where("false")
    if not banding_helps(threshold, bits):
        return star.unionByName(dense_edges(firsts.select(F.col("first").alias("id"), "h"), threshold))
    pairs = hamming_pairs(firsts.select(F.col("first").alias("id"), "h"), threshold, bits, cheaper_near(firsts.count(), threshold, bits))
    return star.unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def ranked(entries: DataFrame, *order: str) -> DataFrame:
    """entries with `rn`, their place (from 0) in the order given, and `_range`, by ranges: no task sorts everything."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = materialise(entries.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    local = table.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("rn", F.col("_rank") + F.col("_before")).withColumnRenamed("_part", "_range").drop("_rank", "_before")


def burst_pairs(entries: DataFrame, seconds: float, threshold: int, window: int) -> DataFrame:
    """J-06: (a, b, distance) of entries (id, h, dt) close in time and signature: b follows a in the order of (dt, id) by at
    most `window` places and `seconds`, and their signatures differ in at most `threshold` bits.

    Joined by buckets of `window` places and of twice `seconds`, so an anchor meets at most 2 * window rows however many share one
    moment, and few where moments are far apart.
    """
    places = ranked(entries.where("dt IS NOT NULL"), "dt", "id")
    # rows with nothing close in time on either side have no pair; at the edges of a range that isn't known here
    order = Window.partitionBy("_range").orderBy("rn")
    close = lambda other: F.coalesce(F.abs(other.over(order) - F.col("dt")) <= seconds, F.lit(True))
    rows = places.withColumn("_close", close(F.lag("dt")) | close(F.lead("dt"))).where("_close").withColumn("bucket", F.floor(F.col("rn") / window))
    rows = rows.withColumn("moment", F.floor(F.col("dt") / (2 * seconds)) if seconds > 0 else F.lit(0))  # twice: safe from rounding
    both = F.explode(F.array(*[F.struct((F.col("bucket") + i).alias("bucket"), (F.col("moment") + j).alias("moment")) for i in (0, 1) for j in ((0, 1) if seconds > 0 else (0,))]))
    anchors = rows.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("dt").alias("ta"), F.col("rn").alias("ra"), both.alias("_key")).select("a", "ha", "ta", "ra", "_key.*")
    others = rows.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("dt").alias("tb"), F.col("rn").alias("rb"), "bucket", "moment")
    distance = hamming(F.col("ha"), F.col("hb"))
    near = (F.col("rb") - F.col("ra")).between(1, window) & (F.col("tb") - F.col("ta") <= seconds) & (distance <= threshold)
    return anchors.join(others, ["bucket", "moment"]).where(near).select("a", "b", distance.alias("distance"))


def cluster_similar(files: DataFrame, cfg: Config | None = None) -> DataFrame:
    """G-01, G-02, P-16, U-01: (component, file_id, similarity_score) of groups of two and more; files (id, h, exif_dt).
    The representative is the smallest id and scores 1."""
    cfg = cfg or Config()
    entries = files.where("h IS NOT NULL").select("id", "h", F.col("exif_dt").alias("dt"))
    edges = similar_edges(entries.select("id", "h"), cfg.hamming_threshold, cfg.phash_bits)
    bursts = burst_pairs(entries, cfg.burst_seconds, cfg.burst_hamming_threshold, cfg.burst_max_window)
    found = materialise(connected_components(edges.unionByName(bursts.select(F.col("a").alias("src"), F.col("b").alias("dst")))), "similar-components")
    return component_scores(found, entries.select("id", "h"), cfg.phash_bits)


def component_scores(components: DataFrame, entries: DataFrame, bits: int = 64) -> DataFrame:
    """G-02: components (id, component) and entries (id, h) to (component, file_id, similarity_score)."""
    reps = entries.select(F.col("id").alias("component"), F.col("h").alias("rep_h"))
    rows = components.join(entries, "id").join(reps, "component")
    score = F.round(1 - hamming(F.col("h"), F.col("rep_h")) / F.lit(float(bits)), 4)
    return rows.select("component", F.col("id").alias("file_id"), score.alias("similarity_score"))
