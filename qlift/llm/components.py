"""Connected components of a link table, by alternating star operations (no driver state but three numbers a round)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``nk, m`` per node: the negated node and the least of itself and its neighbours.

    The key is negated on both sides of the join below so that neither side counts as partitioned already: then both
    are exchanged by the join itself, and adaptive execution can split the partitions of a node with many links.
    """
    return (pairs.groupBy("u").agg(F.min("v").alias("m"))
            .select((-F.col("u")).alias("nk"), F.least("u", "m").alias("m")))


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``links`` (two ``long`` columns ``a, b``).

    Each round hangs every node's larger neighbours on the least node it knows, then its smaller ones; the links
    become stars whose centres are the answers, in a number of rounds logarithmic in practice.  Every round ends in a
    checkpoint of the shared folder.  Raises if the links have not settled after ``max_rounds``.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = saved(e)
    before = None
    for _ in range(max_rounds):
        # two 64-bit hashes of every link, one summed whole and one by exclusive or: equal for different links in one of 2**128 cases
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(11), "u", "v"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.where("v > u").withColumn("nk", -F.col("u"))
                 .join(_least_neighbour(both), "nk").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _least_neighbour(large)
        small = (large.withColumn("nk", -F.col("u")).join(least, "nk")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
                 .union(least.select((-F.col("nk")).alias("u"), F.col("m").alias("v"))).distinct())
        e = saved(small)
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
