"""Connected components of an edge table, distributed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the smallest node reached: alternating large and small stars.

    Minima are aggregated and joined back, so a hub never stands in one task as a list; each round is a written table and the
    number of rounds grows with the logarithm of the longest path."""

    def stamp(e):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]

    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = stamp(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        after = stamp(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
