"""Connected components of edge tables by alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node that an edge (a, b: bigint, not null) joins to a smaller one.

    Each round links every node to the smallest neighbour it knows, first over its larger neighbours, then over
    its smaller ones; rounds double the reach, and end when a round changes nothing. Every round is written to the
    shared folder, so a lost executor costs one round and lineage stays short. A node's neighbours are never
    collected: both steps are a min aggregate and a join. Loops and repeated edges are fine; no edges, no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _mark(after)
        remove(e)
        if new == mark:
            e = after
            break
        e, mark = after, new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
