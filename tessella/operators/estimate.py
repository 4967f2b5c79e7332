"""Counts of windows and points in rectangles: exact, and by forests of midpoint trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import trees
from .range_join import box_pairs


def overlap_counts(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """block_id, queries: windows whose interior meets the box's."""
    w = windows.select("lx", "ly", "hx", "hy")
    hit = box_pairs(w, boxes).where(g.overlaps(g.box(), g.window())).groupBy("block_id").agg(F.count("*").alias("q"))
    return boxes.select("block_id").join(hit, "block_id", "left").select("block_id", F.coalesce("q", F.lit(0)).cast("bigint").alias("queries"))


def skipped_share(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """skipped: window-point pairs that pruning saves, over all pairs."""
    total = windows.agg(F.count("*").alias("all_q"))
    counted = boxes.select("block_id", "n").join(overlap_counts(boxes, windows), "block_id").crossJoin(F.broadcast(total))
    return counted.agg((F.sum((F.col("all_q") - F.col("queries")) * F.col("n")) / F.nullif(F.max("all_q") * F.sum("n"), F.lit(0)).cast("double")).alias("skipped"))


def forest(points: DataFrame, granularity: int = 16384, n_trees: int = 3, seed: int = 11, weight: str | None = None) -> DataFrame:
    """tree_id, x_lo, y_lo, x_hi, y_hi, cnt: the leaves of random midpoint trees over the points, with their counts (or summed weights)."""
    xy, share = trees.bounded(points)
    total = F.count("*") if weight is None else F.sum(weight)
    parts = []
    for k in range(n_trees):
        tree = trees.grow(xy, max(1, granularity * share), trees.random_split(seed + k))
        parts.append(trees.routed(points, tree).groupBy("leaf").agg(F.min("x").alias("x_lo"), F.min("y").alias("y_lo"), F.max("x").alias("x_hi"), F.max("y").alias("y_hi"), total.cast("double").alias("cnt")).select(F.lit(k).alias("tree_id"), "x_lo", "y_lo", "x_hi", "y_hi", "cnt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimated(cells: DataFrame, windows: DataFrame, n_trees: int = 3) -> DataFrame:
    """qid, estimate: mean over the trees, leaves counting by the share of them that the window covers."""
    share = F.when(g.covers(g.window(), g.box()), 1.0).otherwise(F.coalesce(g.overlap_ratio(g.box(), g.window()), F.when(g.may_hold(g.box(), g.window()), 1.0).otherwise(0.0)))
    hit = box_pairs(windows, cells).where(g.may_hold(g.box(), g.window())).groupBy("qid").agg((F.sum(F.col("cnt") * share) / n_trees).alias("e"))
    return windows.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("e", F.lit(0.0)).alias("estimate"))


def quadrants(points: DataFrame, windows: DataFrame, px: float, py: float) -> DataFrame:
    """One row: points (n_a ... n_d), window low corners (s_a ...) and high corners (e_a ...) in the quadrants of a split."""
    right = lambda c: F.col(c) >= F.lit(px)
    top = lambda c: F.col(c) >= F.lit(py)
    of = {"a": lambda x, y: ~right(x) & ~top(y), "b": lambda x, y: right(x) & ~top(y), "c": lambda x, y: ~right(x) & top(y), "d": lambda x, y: right(x) & top(y)}
    n = points.agg(*(F.count_if(f("x", "y")).alias(f"n_{k}") for k, f in of.items()))
    w = windows.agg(*(F.count_if(f("lx", "ly")).alias(f"s_{k}") for k, f in of.items()), *(F.count_if(f("hx", "hy")).alias(f"e_{k}") for k, f in of.items()))
    return n.crossJoin(w)


def split_objective(counted: DataFrame, block: int) -> DataFrame:
    """cost and ordering of a four-way split from quadrants(); a quadrant under a quarter of a block makes cost null."""
    read = lambda n: F.when(F.col(n) <= block, F.lit(float(block))).otherwise((F.ceil((F.col(n) - block) / (3.0 * block)) * 3 + 1) * float(block))
    na, nb, nc, nd = (read(f"n_{k}") for k in "abcd")
    sa, sb, sc, sd = (F.col(f"s_{k}") + 1 for k in "abcd")
    ea, eb, ec, ed = (F.col(f"e_{k}") + 1 for k in "abcd")
    low = na * (sa + ea) + nb * (sb + eb) + nc * (sc + ec) + nd * (sd + ed)
    common = na * (eb + ec + ed) + nb * (sa + ed) + nc * (sa + ed) + nd * (sa + sb + sc)
    fits = F.least(*(F.col(f"n_{k}") for k in "abcd")) >= 0.25 * block
    yx, xy = common + ec + sb, common + eb + sc
    return counted.select(F.when(fits, low + F.least(yx, xy)).alias("cost"), (fits & (yx > xy)).alias("ordering"))
