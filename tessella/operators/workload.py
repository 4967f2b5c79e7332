"""Synthetic and sampled workloads: mixtures, query centres, area windows and windows of a target count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import area_window
from .grids import box_estimate, box_filter, density_grid, local_spread, normalize, prefix_sums
from .range_join import knn_join


def scales(n: int) -> list[float]:
    """n spreads from wide to narrow, evenly in the logarithm of 10^0.1 ... 10^1.4."""
    return [float(v) for v in np.logspace(0.1, 1.4, n)[::-1]]


def covariance(seed: int, b: float = 0.003) -> np.ndarray:
    m = np.random.default_rng(seed).uniform(-1, 1, (2, 2))
    return m @ m.T * b


def in_order_of_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by the hash of their key: a shuffle that any cluster repeats."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def gaussian(spark: SparkSession, mean, cov, n: int, seed: int, first_id: int = 0, noise: float = 1e-4) -> DataFrame:
    """pid, x, y: n points of a normal distribution cut to the open unit square; the first max(1, n * noise) are uniform.

    Each point draws 64 times from streams that belong to its id and takes the first draw inside, or a uniform point.
    """
    values, vectors = np.linalg.eigh(np.asarray(cov, float))  # scaled diagonals may leave the cone: negative parts are cut
    low = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, 0)) @ vectors.T + 1e-12 * np.eye(2))
    uniform = max(1, int(n * noise))

    def unit(k: int, axis: int):
        return (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k), F.lit(axis)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))

    def draw(k):
        u = lambda axis: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k, F.lit(axis)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
        radius, angle = F.sqrt(F.lit(-2.0) * F.log(u(0))), F.lit(2 * np.pi) * u(1)
        a, b = radius * F.cos(angle), radius * F.sin(angle)
        return F.struct((a * float(low[0, 0]) + float(mean[0])).alias("x"), (a * float(low[1, 0]) + b * float(low[1, 1]) + float(mean[1])).alias("y"))

    inside = lambda p: (p["x"] > 0) & (p["x"] < 1) & (p["y"] > 0) & (p["y"] < 1)
    tried = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(64)), draw), inside), F.lit(0))
    p = F.when(F.col("id") < uniform, None).otherwise(tried)
    return spark.range(n).withColumn("p", p).select((F.col("id") + first_id).alias("pid"), F.coalesce("p.x", unit(-1, 0)).alias("x"), F.coalesce("p.y", unit(-1, 1)).alias("y"))


def mixture(spark: SparkSession, n: int, clusters: int, scale: float, seed: int, noise: int = 10_000) -> DataFrame:
    """A data set of n points: uniform noise and clusters of equal size with means in [0.05, 0.95]^2, in order of hash."""
    rng = np.random.default_rng(seed)
    each, parts = n // clusters + 1, [gaussian(spark, (0.5, 0.5), np.eye(2), min(noise, n), seed, 0, 1.0)]
    for k in range(clusters):
        cov = covariance(seed * 1000 + k)
        cov[np.diag_indices(2)] *= scale
        parts.append(gaussian(spark, 0.9 * rng.random(2) + 0.05, cov, each, seed + 1 + k, noise + k * each))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return in_order_of_hash(out, "pid", n, seed)


def centers_synthetic(points: DataFrame, n: int, clusters: int, scale: float, seed: int) -> DataFrame:
    """cid, cx, cy: centres around points drawn from the data, for the mixture's means (as many as clusters)."""
    spark, rows = points.sparkSession, in_order_of_hash(points, "pid", clusters, seed).select("x", "y").collect()
    each, out = n // max(1, len(rows)) + 1, None
    for k, (x, y) in enumerate(rows):
        cov = covariance(seed * 7 + k)
        cov[np.diag_indices(2)] *= scale
        part = gaussian(spark, (x, y), cov, each, seed + 31 * k, k * each)
        out = part if out is None else out.unionByName(part)
    return in_order_of_hash(out, "pid", n, seed).select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))


def centers_real(points: DataFrame, n: int, clusters: int, k: int, scale: float, seed: int) -> DataFrame:
    """cid, cx, cy, sd_x, sd_y: centres around the centroids of the k nearest points of drawn points, spread as those are."""
    seeds = in_order_of_hash(points, "pid", clusters, seed).select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = knn_join(seeds, points, k).join(points.select("pid", "x", "y"), "pid")
    spark, out = points.sparkSession, None
    spread = local_spread(near).orderBy("cid").collect()
    each = n // max(1, len(spread)) + 1
    for i, r in enumerate(spread):
        part = gaussian(spark, (r.mean_x, r.mean_y), np.diag([r.sd_x**2 * scale, r.sd_y**2 * scale]), each, seed + 17 * i, i * each).withColumns({"sd_x": F.lit(r.sd_x), "sd_y": F.lit(r.sd_y)})
        out = part if out is None else out.unionByName(part)
    return in_order_of_hash(out, "pid", n, seed).select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"), "sd_x", "sd_y")


def area_windows(centers: DataFrame, fraction: float) -> DataFrame:
    return centers.select(F.col("cid").alias("qid"), *area_window(F.col("cx"), F.col("cy"), fraction))


def prefix_array(points: DataFrame, size: int) -> np.ndarray:
    """The dense prefix grid with a zero border: size^2 counts, however many points there are."""
    out = np.zeros((size, size), np.int64)
    for r in prefix_sums(density_grid(points, size), size).toLocalIterator():
        out[r.cx, r.cy] = r.total
    return np.pad(out, ((1, 0), (1, 0)))


def estimate_at(prefix: np.ndarray, lx, ly, hx, hy) -> np.ndarray:
    """Points in the cells that the rectangles touch."""
    size = prefix.shape[0] - 1
    cut = lambda v: np.clip(np.floor(v * size).astype(int), 0, size - 1)
    a, b, c, d = cut(lx), cut(ly), cut(hx) + 1, cut(hy) + 1
    return prefix[c, d] - prefix[a, d] - prefix[c, b] + prefix[a, b]


COUNT_WINDOWS = "qid bigint, lx double, ly double, hx double, hy double, target_count bigint, estimated_count bigint"


def count_windows(centers: DataFrame, prefix: np.ndarray, target: int, steps: int = 30) -> DataFrame:
    """Windows around centres (cid, cx, cy, sd_x, sd_y) whose estimated count is nearest the target.

    The half sides are alpha times the local spreads, within [1e-4, 0.5]; alpha is bisected in [1e-3, 50] and the best
    window seen is kept. The prefix grid has a fixed size and travels with the function.
    """

    def run(batches):
        for d in batches:
            low, high = np.full(len(d), 1e-3), np.full(len(d), 50.0)
            best, found = np.full(len(d), np.inf), np.zeros((len(d), 5))
            for _ in range(steps):
                alpha = (low + high) / 2
                wide, tall = (np.clip(alpha * d[c], 1e-4, 0.5) for c in ("sd_x", "sd_y"))
                r = [np.clip(v, 0, 1) for v in (d.cx - wide, d.cy - tall, d.cx + wide, d.cy + tall)]
                n = estimate_at(prefix, *r)
                gap = np.abs(n - target)
                better = gap < best
                best = np.where(better, gap, best)
                found = np.where(np.asarray(better)[:, None], np.stack([*r, n], axis=1), found)
                low, high = np.where(n < target, alpha, low), np.where(n < target, high, alpha)
            yield pd.DataFrame({"qid": d.cid, "lx": found[:, 0], "ly": found[:, 1], "hx": found[:, 2], "hy": found[:, 3], "target_count": target, "estimated_count": found[:, 4].astype(np.int64)})

    return centers.select("cid", "cx", "cy", "sd_x", "sd_y").mapInPandas(run, COUNT_WINDOWS)


#: Least and greatest side of a world box in degrees, of latitude and of longitude alike.
SIDES = (5.0, 30.0)


def world_box(seed: int, lat_sides: tuple[float, float] = SIDES, lon_sides: tuple[float, float] = SIDES) -> tuple[float, float, float, float]:
    """Two latitudes, two longitudes: a box of drawn sides with a centre uniform on the sphere; cut off at the poles, shifted to stay
    within 180 degrees of longitude."""
    rng = np.random.default_rng(seed)
    lat, lon = float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))
    tall, wide = float(rng.uniform(*lat_sides)), min(360.0, float(rng.uniform(*lon_sides)))
    west = min(max(lon - wide / 2, -180.0), 180.0 - wide)
    return max(-90.0, lat - tall / 2), min(90.0, lat + tall / 2), west, west + wide


def real_sample(places: DataFrame, grid: DataFrame, low: int, high: int, target: int, seed: int, tries: int = 100, sides: tuple[float, float] = SIDES) -> DataFrame | None:
    """pid, x, y of `target` places from the first box whose estimate is in range and that holds enough, normalised; None if no box does."""
    for k in range(tries):
        box = world_box(seed * 1000 + k, sides, sides)
        if low <= box_estimate(grid, *box).first()[0] <= high:
            inside = box_filter(places, *box)
            if inside.count() >= target:
                points = inside.select(F.monotonically_increasing_id().alias("pid"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
                return normalize(in_order_of_hash(points, "pid", target, seed))
    return None


def workload(points: DataFrame, fractions: list[float], n_windows: int, clusters: int = 5, levels: int = 5, size: int = 512, seed: int = 1, k: int = 64):
    """Yields (scale, fraction, area windows, count windows) for every scale and fraction."""
    n, prefix = points.count(), prefix_array(points, size)
    for i, scale in enumerate(scales(levels)):
        centers = centers_real(points, n_windows, clusters, k, scale, seed + i)
        for fraction in fractions:
            yield scale, fraction, area_windows(centers, fraction), count_windows(centers, prefix, max(1, round(n * fraction)))
