"""Density grids, prefix sums, grid estimates, entropy, and the world grid of latitudes and longitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell


def density_grid(points: DataFrame, size: int) -> DataFrame:
    """cx, cy, cnt of the cells that hold points of the unit square."""
    return points.groupBy(cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy")).agg(F.count("*").alias("cnt"))


def dense_grid(grid: DataFrame, size: int) -> DataFrame:
    """All size x size cells."""
    ids = grid.sparkSession.range(size * size).select(F.floor(F.col("id") / size).cast("bigint").alias("cx"), (F.col("id") % size).alias("cy"))
    return ids.join(grid, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def prefix_sums(grid: DataFrame, size: int) -> DataFrame:
    """cx, cy, total: points in the cells up to and including this one in both dimensions."""
    up_to = lambda keep, along: Window.partitionBy(keep).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    rows = dense_grid(grid, size).withColumn("row", F.sum("cnt").over(up_to("cx", "cy")))
    return rows.select("cx", "cy", F.sum("row").over(up_to("cy", "cx")).cast("bigint").alias("total"))


def grid_estimate(grid: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """qid, estimate: the counts of all cells that the window touches, whole cells, clamped to the grid."""
    w = windows.select("qid", *(cell(F.col(c), size).alias(f"_{c}") for c in ("lx", "ly", "hx", "hy")))
    # a window's cells by x only; the other dimension is a residual test
    spans = w.where("_lx <= _hx").withColumn("cx", F.explode(F.sequence("_lx", "_hx")))
    sums = spans.join(grid, "cx").where("cy between _ly and _hy").groupBy("qid").agg(F.sum("cnt").alias("s"))
    return w.select("qid").join(sums, "qid", "left").select("qid", F.coalesce("s", F.lit(0)).cast("bigint").alias("estimate"))


def _bin(c: str, bins: int):
    at = F.floor((F.col(c) - F.col(f"_{c}0")) / F.nullif(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0)) * bins)
    return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(bins // 2)).cast("bigint")


def entropy_2d(points: DataFrame, bins: int = 512) -> DataFrame:
    """entropy: of the histogram between the smallest and largest coordinates; empty cells count with probability 1e-9."""
    bounds = points.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.count("*").alias("_n"))
    counts = points.crossJoin(F.broadcast(bounds)).groupBy(_bin("x", bins).alias("i"), _bin("y", bins).alias("j"), "_n").agg(F.count("*").alias("c"))
    p = F.greatest(F.col("c") / F.col("_n"), F.lit(1e-9))
    floor = float(-1e-9 * __import__("math").log2(1e-9))
    return counts.agg((F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)) + (F.lit(bins * bins) - F.count("*")) * F.lit(floor)).alias("entropy"))


def normalized_entropy(points: DataFrame, reference: DataFrame, bins: int = 512) -> DataFrame:
    """entropy, reference, normalized: against a uniform sample of the same size."""
    return entropy_2d(points, bins).crossJoin(entropy_2d(reference, bins).withColumnRenamed("entropy", "reference")).withColumn("normalized", F.col("entropy") / F.col("reference"))


def world_grid(places: DataFrame, lat_step: float = 0.05, lon_step: float = 0.1) -> DataFrame:
    """ci, cj, cnt over [-90, 90) x [-180, 180); places outside are left out."""
    rows, cols = round(180 / lat_step), round(360 / lon_step)
    i = F.floor((F.col("lat").cast("double") + 90.0) / F.lit(lat_step)).cast("bigint")
    j = F.floor((F.col("lon").cast("double") + 180.0) / F.lit(lon_step)).cast("bigint")
    return places.select(i.alias("ci"), j.alias("cj")).where(F.col("ci").between(0, rows - 1) & F.col("cj").between(0, cols - 1)).groupBy("ci", "cj").agg(F.count("*").alias("cnt"))


def box_estimate(grid: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float, lat_step: float = 0.05, lon_step: float = 0.1) -> DataFrame:
    """estimate: counts of the cells that the box touches."""
    import math

    a, b = sorted((lat0, lat1))
    c, d = sorted((lon0, lon1))
    i = [math.floor((v + 90) / lat_step) for v in (a, b)]
    j = [math.floor((v + 180) / lon_step) for v in (c, d)]
    return grid.where(F.col("ci").between(*i) & F.col("cj").between(*j)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("estimate"))


def box_filter(places: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float) -> DataFrame:
    """Places in a closed box; bounds in either order."""
    return places.where(F.col("lat").between(min(lat0, lat1), max(lat0, lat1)) & F.col("lon").between(min(lon0, lon1), max(lon0, lon1)))


def normalize(points: DataFrame) -> DataFrame:
    """Points scaled to the unit square by their own bounds (sides of 1e-9 at least), then clipped."""
    from ..functions.geometry import clip_unit

    b = points.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    scaled = lambda c: clip_unit((F.col(c) - F.col(f"_{c}0")) / F.greatest(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(1e-9)))
    return points.crossJoin(F.broadcast(b)).withColumns({"x": scaled("x"), "y": scaled("y")}).drop("_x0", "_y0", "_x1", "_y1")


def local_spread(neighbours: DataFrame) -> DataFrame:
    """cid, mean_x, mean_y, sd_x, sd_y of each centre's neighbours (cid, x, y); sd from the population variance plus 1e-6."""
    sd = lambda c: F.coalesce(F.sqrt(F.var_pop(c) + F.lit(1e-6)), F.lit(1e-3))
    return neighbours.groupBy("cid").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), sd("x").alias("sd_x"), sd("y").alias("sd_y"))
