"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, discard


def _least(pairs: DataFrame) -> DataFrame:
    """The smallest of each node's neighbours and itself; partial sums meet before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    large = both.join(_least(both), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = large.join(_least(large), F.col("u") == F.col("k"))
    return linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, root)``, where root is the smallest node that node reaches.

    Self-links, repeated links and nulls are dropped; an empty input gives an empty result. Every round
    is written to the shared folder, and the work ends when a round changes nothing, so chains of any
    length are followed to their end (a logarithmic number of rounds).
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        then, now = now, cut(_round(now))
        discard(then)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
