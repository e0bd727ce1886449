"""Connected components of a large graph by alternating star operations.

Each round points every node's larger neighbours to its smallest neighbour
(large star), then every node and its smaller neighbours to the smallest of
them (small star); stars remain after a number of rounds that grows with the
logarithm of the graph. Rounds are written to shared storage, and only two
numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """``edges (u, v)`` with ``m``, the smallest of u and its neighbours; the minimum is combined where the rows are."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(low, F.col("u") == F.col("w")).drop("w")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    return found.select("v", "m").unionByName(found.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges (u long, v long)``; the
    component is its smallest node. Loops, repeats and direction don't matter."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # a modulus keeps the sum of hashes far from overflow
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == before:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
