"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.plans.checkpoint import cut


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)`` (long ids), the component being its smallest node.

    Alternating large-star and small-star rounds. Each round aggregates the
    smallest neighbour with partial aggregation and joins it back, so a node with
    very many links is a skewed join side that adaptive execution splits and is
    never collected into one task. Rounds are cut by checkpoints. Self-links and
    repeated links count once; an empty input gives an empty result.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        if tuple(now) == seen or now["n"] == 0:
            break
        seen = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
