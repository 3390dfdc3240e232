"""Connected components of an edge table, by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import staged

MAX_ROUNDS = 60


def connected(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """edges: u, v (of one type). Returns node, root for every node of an edge that joins two nodes; root is the smallest node reachable.

    Null ends, loops and repeated edges are ignored; no edges give no rows. Each round groups by a node with partial
    aggregates and joins on it, so a hub's edges are never gathered. Stars settle in about log rounds.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("count(distinct u)")).first()
        if state == before or state[0] == state[2] and not now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
