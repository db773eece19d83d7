"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form one group. Groups are summarised as a histogram (size class -> count), which is
what the driver sees: equal sizes are interchangeable, so a class is placed in bulk. Sizes from the largest
down enter the bin with the tightest remaining capacity that still holds them, found in a balanced (AVL) tree
of capacities. The capacity is the smallest one, found by bisection, for which the fixed number of bins is
enough, so the fullest shard is as small as this packing can make it.

Scale: a size class is the group's bytes rounded up to CLASS_BITS binary digits, at every size alike, so a class is exact up to
8,192 bytes and at most 0.025 % above the bytes beyond; there are at most 4,096 classes for each doubling, 160,000 up to
a petabyte, and that bounds what the driver holds. Numbers within a class and slots within a shard come from sorted
partitions plus offsets: a row's place in its partition is known where it is written, and only counts by
(class or shard, partition) are added up. No shard, class or group is ever gathered in one task.

Defined results: null text = no bytes (size 1) but equal to the empty text; null ids stay null and get a slot
like any row; repeated rows stay and share their group's shard; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, read_table, spark_partitions

CLASS_BITS = 13


class CapacityTree:
    """AVL tree of (remaining capacity, bin): tightest bin that holds a size in O(log bins)."""

    class _Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n.height if n else 0

    def _fix(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn_left(n.left)
            return self._turn_right(n)
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn_right(n.right)
            return self._turn_left(n)
        return n

    def _turn_left(self, n):
        r = n.right
        n.right, r.left = r.left, n
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        r.height = 1 + max(self._h(r.left), self._h(r.right))
        return r

    def _turn_right(self, n):
        left = n.left
        n.left, left.right = left.right, n
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        left.height = 1 + max(self._h(left.left), self._h(left.right))
        return left

    def insert(self, key) -> None:
        def put(n):
            if n is None:
                return self._Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def smallest(n):
            while n.left:
                n = n.left
            return n.key

        def drop(n, k):
            if n is None:
                return None
            if k < n.key:
                n.left = drop(n.left, k)
            elif n.key < k:
                n.right = drop(n.right, k)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                n.key = smallest(n.right)
                n.right = drop(n.right, n.key)
            return self._fix(n)

        self.root = drop(self.root, key)

    def tightest(self, size: int):
        """The smallest (capacity, bin) with capacity >= size, or None."""
        n, found = self.root, None
        while n:
            if n.key >= (size, -1):
                found, n = n.key, n.left
            else:
                n = n.right
        return found


def best_fit_decreasing(classes: list[tuple[int, int]], bins: int, capacity: int) -> list[tuple[int, int, int]] | None:
    """Place (size, count) classes, largest size first: [(class index, bin, how many)], or None if they don't fit."""
    tree = CapacityTree()
    for b in range(bins):
        tree.insert((capacity, b))
    placed = []
    for i in sorted(range(len(classes)), key=lambda i: (-classes[i][0], i)):
        size, left = classes[i]
        while left:
            found = tree.tightest(size)
            if found is None:
                return None
            n = min(left, found[0] // size)
            tree.remove(found)
            tree.insert((found[0] - n * size, found[1]))
            placed.append((i, found[1], n))
            left -= n
    return placed


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """best_fit_decreasing at the smallest capacity that bisection finds to be enough."""
    if not classes:
        return []
    total = sum(s * n for s, n in classes)
    low = max(-(-total // bins), max(s for s, _ in classes))
    high = low
    while (best := best_fit_decreasing(classes, bins, high)) is None:
        high += max(1, high // 16)
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(classes, bins, mid)) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return best


def size_class(size: str):
    """size rounded up to a number of CLASS_BITS binary digits and zeros."""
    unit = f"shiftleft(1L, greatest(0, length(bin({size})) - {CLASS_BITS}))"
    return F.expr(f"(({size} + {unit} - 1) div {unit}) * {unit}")


def _numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, whose partitions are sorted by key, plus `number`: gapless from 0 within each key. Rows are written with their
    place in the partition; only counts by key and partition are added up."""
    written = materialise(df.withColumn("_place", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_place", 33))
    counts = written.groupBy(key, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return written.join(counts, [key, "_part"]).withColumn("number", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_first", "_before")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; equal texts share a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).select("group", size_class("bytes").alias("class"))
    ranged = groups.repartitionByRange(spark_partitions(spark), "class", "group").sortWithinPartitions("class", "group")
    groups = _numbered(ranged, "class", "shard-groups")
    counts = sorted(tuple(r) for r in groups.groupBy("class").agg(F.count("*")).collect())
    placed, ranges, at = pack(counts, shards), [], {}
    for i, shard, n in placed:
        a = at.get(i, 0)
        ranges.append((counts[i][0], a, a + n, shard))
        at[i] = a + n
    # a line for each class and for each bin that a class fills: see the module's bound
    plan = F.broadcast(spark.createDataFrame(ranges, "class long, a long, b long, shard int"))
    homes = groups.join(plan, "class").where("number >= a AND number < b").select("group", "shard")
    dealt = rows.join(homes, "group").select("doc_id", "size", "text_crc32", "shard").sortWithinPartitions("shard")
    dealt = _numbered(dealt, "shard", "shard-dealt")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))


SQL: dict = {}
QUERIES = {"op5_sharding": op5_sharding}
