"""Connected components by randomised contraction (G-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

MAX_ROUNDS = 60
ID_ROUNDS = 3


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of an edge list; component is the smallest id of the component.

    Each round sends a vertex to the member of its closed neighbourhood that ranks first and keeps the edges between different
    targets. The first rounds rank by id, which settles trees of as many steps around a smallest id whatever their size; the others by a
    hash, another one each round, which makes the expected number of edges of long chains shrink by a constant factor, so rounds grow with
    the logarithm of the input. Vertex tables of all rounds are composed at the end. Edges are pre-aggregated before each shuffle; nothing is collected.
    Self-loops make a vertex; null ends are ignored; repeated edges are harmless.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    e = materialise(e, "cc-edges")
    maps = []
    for turn in range(MAX_ROUNDS):
        both = e.select("a", "b").union(e.select("b", "a")).union(e.select("a", F.col("a").alias("b"))).union(e.select(F.col("b").alias("a"), "b"))
        rank = F.struct((F.xxhash64("b", F.lit(turn)) if turn >= ID_ROUNDS else F.col("b")).alias("key"), F.col("b"))
        step = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min(rank).getField("b").alias("to")), "cc-step")
        maps.append(step)
        moved = (
            e.where("a <> b")
            .join(step.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        e = materialise(moved, "cc-edges")
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    label = maps[-1]
    for step in reversed(maps[:-1]):
        later = label.select(F.col("v").alias("to"), F.col("to").alias("top"))
        label = step.join(later, "to", "left").select("v", F.coalesce("top", "to").alias("to"))
    label = materialise(label, "cc-labels") if len(maps) > 1 else label
    least = label.groupBy("to").agg(F.min("v").alias("component"))
    out = label.join(least, "to").select(F.col("v").alias("id"), "component")
    return out
