"""Connected components by alternating large-star and small-star rounds, all of it joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges(u, v)` of longs -> `(id, root)` for every id on an edge; root is the smallest id reachable.

    Self-loops and repeated edges are harmless; an empty table gives an empty table. Each round is written
    to the shared folder, and the round before it is deleted.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc")
    sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), sign).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        nxt = materialize(_small_star(_large_star(now).distinct()).distinct(), "cc")
        got = nxt.agg(F.count("*"), sign).first()
        discard(now)
        now = nxt
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
