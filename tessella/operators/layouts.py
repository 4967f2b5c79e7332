"""Layouts: every builder gives each point a block_id and a table of blocks; answers never depend on the layout."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.curve import morton
from ..sources.shared import written
from . import trees
from .range_join import box_pairs, point_weights
from .ranks import global_rank, ntile_of

BLOCK = 256
BRANCH = 16


class Layout(NamedTuple):
    """points: pid, x, y, block_id. meta: block_id, x_lo, y_lo, x_hi, y_hi (the closed box of its points), n."""

    points: DataFrame
    meta: DataFrame


def block_table(points: DataFrame) -> DataFrame:
    return points.groupBy("block_id").agg(F.min("x").alias("x_lo"), F.min("y").alias("y_lo"), F.max("x").alias("x_hi"), F.max("y").alias("y_hi"), F.count("*").alias("n"))


def laid_out(points: DataFrame) -> Layout:
    points = written(points.select("pid", "x", "y", F.col("block_id").cast("bigint").alias("block_id")), "layout")
    return Layout(points, block_table(points))


def _from_leaves(points: DataFrame, limit: int | None) -> Layout:
    """Blocks from leaves; a leaf of more than `limit` points is cut into runs of `limit` along (x, y, pid)."""
    if limit is None:
        return laid_out(points.withColumn("block_id", F.col("leaf")))
    run = F.floor((F.row_number().over(Window.partitionBy("leaf").orderBy("x", "y", "pid")) - 1) / limit).cast("bigint")
    return laid_out(points.withColumn("block_id", F.shiftleft("leaf", 24) + run))


def _planned(points: DataFrame, block: int, grow) -> Layout:
    xy, share = trees.bounded(points)
    return _from_leaves(trees.routed(points.select("pid", "x", "y"), grow(xy, max(1.0, block * share))), block)


def kd(points: DataFrame, block: int = BLOCK) -> Layout:
    """Alternating midpoints of the nodes' bounds."""
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.kd_split))


def qd_random(points: DataFrame, block: int = BLOCK, seed: int = 0) -> Layout:
    """Midpoints in dimensions drawn for each node."""
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.random_split(seed)))


def qd(points: DataFrame, windows: DataFrame, block: int = BLOCK) -> Layout:
    """The random tree that is cheapest for the training windows."""
    wins = trees.collected(windows)
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.random_split(trees.search_random(xy, wins, limit)[0])))


def qd_greedy(points: DataFrame, windows: DataFrame, block: int = BLOCK) -> Layout:
    """Greedy cuts by the share of the workload that they let skip."""
    wins = trees.collected(windows)
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.greedy_split(wins, limit)))


def qd_loaded(points: DataFrame, nodes: DataFrame, block: int = BLOCK, seed: int = 0) -> Layout:
    """Points through a saved skeleton (node_id, dim, value); its leaves are finished by runs."""
    return _from_leaves(trees.routed(points.select("pid", "x", "y"), trees.Tree.of_nodes(nodes)), block)


def zindex(points: DataFrame, block: int = BLOCK) -> Layout:
    """Four-way splits at the median point; blocks in Z order."""
    return _planned(points, block, lambda xy, limit: trees.grow_quad(xy, limit)[0])


def wazi(points: DataFrame, windows: DataFrame, block: int = BLOCK) -> Layout:
    """Four-way splits and child orders chosen for the workload."""
    wins = trees.collected(windows)
    return _planned(points, block, lambda xy, limit: trees.grow_quad(xy, limit, wins)[0])


def rstar(points: DataFrame, block: int = BLOCK) -> Layout:
    """Top-down splits of the smallest perimeters, the bulk form of R*-tree splits."""
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.perimeter_split(limit)))


def rw(points: DataFrame, windows: DataFrame, block: int = BLOCK) -> Layout:
    """As rstar, but the cheapest for the workload among the best splits by perimeter."""
    wins = trees.collected(windows)
    return _planned(points, block, lambda xy, limit: trees.grow(xy, limit, trees.perimeter_split(limit, wins)))


def _equi_depth(points: DataFrame, columns: int, dim: str) -> list[float]:
    """Inner boundaries of `columns` NTILE columns: the first value of each but the first. As many as columns at most."""
    if columns <= 1:
        return []
    ranked = global_rank(points.select("pid", "x", "y"), [dim, "pid"], "r")
    n = ranked.count()
    starts = sorted({k * (n // columns) + min(k, n % columns) for k in range(1, columns)})
    rows = ranked.where(F.col("r").isin(starts)).select(dim).collect()
    return sorted({r[0] for r in rows})


def flood_columns(points: DataFrame, columns: tuple[int, int], order: tuple[str, str] = ("x", "y")) -> Layout:
    """Equi-depth columns in each dimension; a cell is a block, cells numbered row by row in the order of dimensions."""
    number = None
    cells = points.select("pid", "x", "y")
    for dim, k in zip(order, columns, strict=True):
        splits = _equi_depth(points, k, dim)
        # array_size of the splits at or below the value: as many as columns, a literal of the plan
        value = F.col(dim)
        at = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= value)) if splits else F.lit(0)  # noqa: B023
        number = at.cast("bigint") if number is None else number * F.lit(len(splits) + 1) + at
    return laid_out(cells.withColumn("block_id", number))


def grid(points: DataFrame, block: int = BLOCK) -> Layout:
    """Square grid: floor(sqrt(N / block)) equi-depth columns in each dimension."""
    k = max(1, int((points.count() // block) ** 0.5))
    return flood_columns(points, (k, k))


def flood(points: DataFrame, windows: DataFrame, block: int = BLOCK, tries: int = 500, patience: int = 25, seed: int = 3) -> Layout:
    """The best of random shapes (cells in [T/2, 2T], aspect in 2^[-2, 2], order) by points scanned over the first 5 % of the windows, on a sample."""
    xy, share = trees.bounded(points, 100_000)
    wins = trees.collected(windows)
    wins = wins[: max(1, len(wins) // 20)]
    rng, best, since = np.random.default_rng(seed), None, 0
    target = -(-max(1, round(len(xy) / share)) // block)
    for _ in range(tries):
        cells, aspect = rng.uniform(target / 2, 2 * target), 2 ** rng.uniform(-2, 2)
        shape = max(1, round((cells * aspect) ** 0.5)), max(1, round((cells / aspect) ** 0.5))
        order = ("x", "y") if rng.random() < 0.5 else ("y", "x")
        sides = [np.unique(np.quantile(xy[:, "xy".index(d)], np.arange(1, k) / k)) if k > 1 and len(xy) else np.zeros(0) for d, k in zip(order, shape, strict=True)]
        place = [np.searchsorted(s, xy[:, "xy".index(d)], "right") for d, s in zip(order, sides, strict=True)]
        counts = np.zeros((len(sides[0]) + 1, len(sides[1]) + 1))
        np.add.at(counts, tuple(place), 1)
        total = counts.cumsum(0).cumsum(1)
        total = np.pad(total, ((1, 0), (1, 0)))
        cost = 0.0
        for w in wins:
            (a, b), (c, d) = ((np.searchsorted(s, w["xy".index(k)], "right"), np.searchsorted(s, w["xy".index(k) + 2], "left") + 1) for s, k in zip(sides, order, strict=True))
            cost += total[b, d] - total[a, d] - total[b, c] + total[a, c] if b > a and d > c else 0
        if best is None or cost < best[0]:
            best, since = (cost, shape, order), 0
        else:
            since += 1
            if since >= patience:
                break
    return flood_columns(points, best[1], best[2])


def _sliced(points: DataFrame, block: int, slice_of) -> Layout:
    """Nodes are cut level by level, in alternating dimensions, until none holds more than `block` points.

    slice_of(ranked, k): the child of a row from its rank in its node (r), the node's size (n) and the number of children (k); of
    weighted points also from the node's weight (total), that before the node (ahead) and that up to the row (g_sum).
    Ranks come from global_rank over (node, dimension, pid), so that no node is ordered by one task; the table of
    open nodes is aggregated and joined, never collected.
    """
    state = points.select(*points.columns, F.lit(0).cast("bigint").alias("node"))
    level = 0
    while True:
        sizes = state.groupBy("node").agg(F.count("*").alias("n"))
        if sizes.where(F.col("n") > block).isEmpty():
            return laid_out(state.withColumn("block_id", F.col("node")))
        dim = "xy"[level % 2]
        weight = "weight" if "weight" in points.columns else None
        ranked = global_rank(state, ["node", dim, "pid"], "g", weight)
        totals = [F.sum("weight").alias("total"), F.min(F.col("g_sum") - F.col("weight")).alias("ahead")] if weight else []
        firsts = ranked.groupBy("node").agg(F.min("g").alias("f"), F.count("*").alias("n"), *totals)
        ranked = ranked.join(firsts, "node").withColumn("r", F.col("g") - F.col("f"))
        k = F.when(F.col("n") <= block, 1).when(F.floor(F.col("n") / BRANCH) >= block, BRANCH).otherwise(F.floor(F.col("n") / block) + 1).cast("bigint")
        state = written(slice_of(ranked.withColumn("k", k)).select(*points.columns, (F.col("node") * BRANCH + F.col("child")).cast("bigint").alias("node")), "level")
        level += 1


def str_tree(points: DataFrame, block: int = BLOCK) -> Layout:
    """Sort-tile-recursive: NTILE slices, 16 children or as many as leaves are needed."""
    return _sliced(points.select("pid", "x", "y"), block, lambda d: d.withColumn("child", ntile_of(F.col("r"), F.col("n"), F.col("k"))))


def cur(points: DataFrame, windows: DataFrame, block: int = BLOCK) -> Layout:
    """Slices of equal weight, a point's weight being 0.5 and one for each training window that holds it; small nodes by count."""

    def slices(d: DataFrame) -> DataFrame:
        before, total = F.col("g_sum") - F.col("ahead"), F.col("total")
        heavy = F.least(F.ceil(before / (total / F.col("k"))) - 1, F.col("k") - 1).cast("bigint")
        return d.withColumn("child", F.when(F.col("n") <= BRANCH * block, ntile_of(F.col("r"), F.col("n"), F.col("k"))).otherwise(heavy))

    return _sliced(point_weights(points, windows), block, slices)


def rank_space(points: DataFrame) -> DataFrame:
    """pid, x, y, rx, ry, z: dense ranks in each dimension (ties by pid) and the Morton code of the ranks."""
    ranked = global_rank(global_rank(points.select("pid", "x", "y"), ["x", "pid"], "rx"), ["y", "pid"], "ry")
    return ranked.withColumn("z", morton(F.col("rx"), F.col("ry")))


def zm(points: DataFrame, block: int = BLOCK) -> Layout:
    """Runs of `block` points along the Morton order of rank space."""
    ranked = global_rank(rank_space(points), ["z"], "place")
    return laid_out(ranked.withColumn("block_id", F.floor(F.col("place") / block)))


def rsmi(points: DataFrame, block: int = BLOCK) -> Layout:
    """Blocks of the recursive rank-space grid: STR slices numbered along the Z order of their (y, x) places."""
    base = str_tree(points, block)
    place = global_rank(global_rank(base.meta.withColumn("cx", (F.col("x_lo") + F.col("x_hi")) / 2).withColumn("cy", (F.col("y_lo") + F.col("y_hi")) / 2), ["cx", "block_id"], "rx"), ["cy", "block_id"], "ry")
    numbered = place.select("block_id", morton(F.col("ry"), F.col("rx")).alias("z"))
    return laid_out(base.points.join(numbered, "block_id").withColumn("block_id", F.col("z")))


# --- queries on layouts


def candidates(layout: Layout, windows: DataFrame) -> DataFrame:
    """qid, block_id, n and the window's bounds: blocks that may hold points of a window; windows upside down have none."""
    return box_pairs(windows.select("qid", "lx", "ly", "hx", "hy"), layout.meta).where(g.may_hold(g.box(), g.window())).select("qid", "lx", "ly", "hx", "hy", "block_id", "n")


def range_query(layout: Layout, windows: DataFrame) -> DataFrame:
    """qid, pid, x, y: prune blocks, then filter their points."""
    return candidates(layout, windows).drop("n").join(layout.points, "block_id").where(g.contains(g.window(), F.col("x"), F.col("y"))).select("qid", "pid", "x", "y")


def range_query_count(layout: Layout, windows: DataFrame) -> DataFrame:
    return range_query(layout, windows).groupBy("qid").agg(F.count("*").alias("cnt"))


def one_window(layout: Layout, lx: float, ly: float, hx: float, hy: float) -> DataFrame:
    """Points of one window from a stored layout: block ids first, then a semi join, with the bounds pushed to the scan."""
    rect = g.Rect(*map(F.lit, (lx, ly, hx, hy)))
    blocks = layout.meta.where(g.may_hold(g.box(), rect)).select("block_id")
    return layout.points.where(g.contains(rect, F.col("x"), F.col("y"))).join(blocks, "block_id", "left_semi").select("pid", "x", "y")


def scan_metrics(layout: Layout, windows: DataFrame) -> DataFrame:
    """qid, refined_blocks, points_scanned of every window."""
    hit = candidates(layout, windows).groupBy("qid").agg(F.count("*").alias("b"), F.sum("n").alias("s"))
    return windows.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("b", F.lit(0)).cast("bigint").alias("refined_blocks"), F.coalesce("s", F.lit(0)).cast("bigint").alias("points_scanned"))


def workload_averages(scanned: DataFrame) -> DataFrame:
    """blocks, scanned: totals over the windows of scan_metrics(), and their means."""
    return scanned.agg(F.sum("refined_blocks").alias("blocks"), F.sum("points_scanned").alias("scanned"), F.avg("refined_blocks").alias("avg_blocks"), F.avg("points_scanned").alias("avg_scanned"))


def covered_points(layout: Layout, windows: DataFrame) -> DataFrame:
    """qid, covered: points in blocks that lie inside the window as a whole."""
    w = windows.select("qid", "lx", "ly", "hx", "hy")
    hit = box_pairs(w, layout.meta).where(g.covers(g.window(), g.box())).groupBy("qid").agg(F.sum("n").alias("s"))
    return w.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("s", F.lit(0)).cast("bigint").alias("covered"))


def size_quantiles(meta: DataFrame) -> DataFrame:
    """q10, q25, q50, q75, q90 (elements at floor(count * q)) and avg (floor of the mean) of the block sizes."""
    # one row for each size that occurs, so there are at most as many as points in the largest block
    counts = meta.groupBy("n").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    total = meta.agg(F.count("*").alias("size"), F.avg("n").alias("m"))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("size") * F.lit(q)), F.col("size") - 1), F.col("n")))
    both = upto.crossJoin(F.broadcast(total))
    return both.agg(*(at(q).alias(f"q{round(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)), F.floor(F.max("m")).cast("bigint").alias("avg"))


def partition_check(layout: Layout, points: DataFrame, block: int) -> DataFrame:
    """n, over (blocks above the promised size), outside (points outside their block's box), lost (points without a block)."""
    inside = layout.points.join(layout.meta, "block_id").where(~g.contains_closed(g.box(), F.col("x"), F.col("y"))).agg(F.count("*").alias("outside"))
    over = layout.meta.agg(F.sum("n").cast("bigint").alias("n"), F.count_if(F.col("n") > block).alias("over"))
    lost = points.join(layout.points.select("pid"), "pid", "left_anti").agg(F.count("*").alias("lost"))
    return over.crossJoin(inside).crossJoin(lost)
