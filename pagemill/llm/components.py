"""Connected components by alternating large-star and small-star rounds, each a pair of shuffles on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link to another; component is the least node it reaches.

    Links of a node with itself, null ends and repeated links change nothing; no links give no rows. A hot node
    is aggregated before its shuffle, and its join is one that adaptive execution splits. Each round is written
    to the shared folder, so an executor lost later costs only its own tasks.
    """
    cur = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    )
    was = _state(cur)
    for _ in range(rounds):
        if not was[0]:
            break
        new = written(_small_star(_large_star(cur)))
        now = _state(new)
        removed(cur)
        cur, (was, same) = new, (now, now == was)
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
