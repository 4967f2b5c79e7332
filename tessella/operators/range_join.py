"""Range joins of points and windows, and nearest neighbours.

Windows are filed by size: a window of largest side s belongs to the level of the smallest power of two not below s,
so it meets at most 2 x 2 cells of that level. Points join by equality on (level, cell), once for each level that
occurs, and the predicate decides. A pair meets at most once, there is no clamping and no domain to know, and
dense cells are ordinary skewed join keys, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import written

#: Levels are powers of two within these exponents; wider windows span more cells of the last level.
LOWEST, HIGHEST = -40, 40


def _levelled(windows: DataFrame, closed: bool) -> DataFrame:
    w = windows.where("lx <= hx and ly <= hy" if closed else "lx < hx and ly < hy")
    side = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))
    level = F.when(side <= 2.0**LOWEST, LOWEST).otherwise(F.least(F.greatest(F.ceil(F.log2(side)), F.lit(LOWEST)), F.lit(HIGHEST)))
    return w.withColumn("_level", level.cast("int"))


def _cell(c, level):
    return F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")


def _filed_windows(levelled: DataFrame) -> DataFrame:
    level = F.col("_level")
    span = lambda lo, hi: F.sequence(_cell(F.col(lo), level), _cell(F.col(hi), level))
    return levelled.withColumn("_cx", F.explode(span("lx", "hx"))).withColumn("_cy", F.explode(span("ly", "hy")))


def _filed_points(points: DataFrame, levels: list[int]) -> DataFrame:
    return points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cx", _cell(F.col("x"), F.col("_level"))).withColumn("_cy", _cell(F.col("y"), F.col("_level")))


def range_pairs(points: DataFrame, windows: DataFrame, *, closed: bool = False) -> DataFrame:
    """Every (point, window) pair with the point inside: the points' columns and the windows' columns.

    Windows that are empty or upside down match nothing; rows without coordinates match nothing. There must be
    no shared column names.
    """
    levelled = _levelled(windows, closed)
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # HIGHEST - LOWEST + 1 at most
    if not levels:
        levels = [0]
    inside = (g.contains_closed if closed else g.contains)(g.window(), F.col("x"), F.col("y"))
    return _filed_points(points, levels).join(_filed_windows(levelled), ["_level", "_cx", "_cy"]).where(inside).drop("_level", "_cx", "_cy")


def range_pairs_nested(points: DataFrame, windows: DataFrame) -> DataFrame:
    """The plain form, for few windows only: every window against every point."""
    return points.join(F.broadcast(windows), g.contains(g.window(), F.col("x"), F.col("y")))


def range_count(points: DataFrame, windows: DataFrame, *, closed: bool = False) -> DataFrame:
    """qid, cnt of the windows that hold points."""
    return range_pairs(points, windows, closed=closed).groupBy("qid").agg(F.count("*").alias("cnt"))


def range_count_all(points: DataFrame, windows: DataFrame, *, closed: bool = False) -> DataFrame:
    """qid, cnt of all windows."""
    return windows.select("qid").join(range_count(points, windows, closed=closed), "qid", "left").select("qid", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def range_semi(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Points (with unique pid) inside any window."""
    hit = range_pairs(points.select("pid", "x", "y"), windows.select("qid", "lx", "ly", "hx", "hy")).select("pid").distinct()
    return points.join(hit, "pid", "left_semi")


def range_anti(points: DataFrame, windows: DataFrame) -> DataFrame:
    hit = range_pairs(points.select("pid", "x", "y"), windows.select("qid", "lx", "ly", "hx", "hy")).select("pid").distinct()
    return points.join(hit, "pid", "left_anti")


def point_weights(points: DataFrame, windows: DataFrame, base: float = 0.5) -> DataFrame:
    """pid, x, y, weight: base plus the number of windows that hold the point."""
    counts = range_pairs(points.select("pid", "x", "y"), windows.select("qid", "lx", "ly", "hx", "hy")).groupBy("pid").count()
    return points.select("pid", "x", "y").join(counts, "pid", "left").select("pid", "x", "y", (F.coalesce("count", F.lit(0)) + F.lit(base)).alias("weight"))


def box_pairs(windows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Windows (lx, ly, hx, hy) with the boxes (x_lo, y_lo, x_hi, y_hi) that they meet or touch, and all other columns of both.

    Both are filed by the power of two of their size, and at the larger levels of the other table as well; a pair meets at the
    larger of its two levels, in the cell of the low corner of what both share, so once. Windows and boxes upside down meet nothing.
    """
    own = lambda df, corners, at: _levelled(df.withColumns(dict(zip(("lx", "ly", "hx", "hy"), map(F.col, corners), strict=True))), True).withColumnRenamed("_level", at)
    corners = ("x_lo", "y_lo", "x_hi", "y_hi")
    w, b = own(windows, ("lx", "ly", "hx", "hy"), "_wl"), own(boxes, corners, "_bl").drop("lx", "ly", "hx", "hy")
    levels = {c: sorted(r[0] for r in d.select(c).distinct().collect()) for c, d in (("_wl", w), ("_bl", b))}  # HIGHEST - LOWEST + 1 at most

    def filed(df: DataFrame, at: str, other: list[int], names) -> DataFrame:
        every = F.array_distinct(F.concat(F.array(F.col(at)), F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda l: l > F.col(at))))
        span = lambda lo, hi: F.sequence(_cell(F.col(lo), F.col("_level")), _cell(F.col(hi), F.col("_level")))
        levelled = df.withColumn("_level", F.explode(every))
        return levelled.withColumn("_cx", F.explode(span(names[0], names[2]))).withColumn("_cy", F.explode(span(names[1], names[3])))

    met = filed(w, "_wl", levels["_bl"], ("lx", "ly", "hx", "hy")).join(filed(b, "_bl", levels["_wl"], corners), ["_level", "_cx", "_cy"])
    first = (F.col("_cx") == _cell(F.greatest("lx", "x_lo"), F.col("_level"))) & (F.col("_cy") == _cell(F.greatest("ly", "y_lo"), F.col("_level")))
    return met.where((F.col("_level") == F.greatest("_wl", "_bl")) & first).drop("_level", "_cx", "_cy", "_wl", "_bl")


def knn_join(centers: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """cid, pid, d2, rank of the k nearest points of every centre (cid, cx, cy), ties by pid: exact.

    A round looks within a radius around the centres that are left; a centre is done when k points lie within the radius, for none
    outside can be nearer. The radius starts at the size that holds about 2k points in the cell of a middling point, far outliers aside, and doubles.
    """
    from pyspark.sql import Window

    span = lambda c: F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)), 1000)
    n, xs, ys = points.agg(F.count("*"), span("x"), span("y")).first()
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "cid bigint, pid bigint, d2 double, rank int")
    wide, high = max(xs[1] - xs[0], 1e-12), max(ys[1] - ys[0], 1e-12)
    side = max((2 * k / n * wide * high) ** 0.5, 1e-12)
    # a cell of the size that holds 2k points at the density of the middle of the data; crowded data start with less
    cells = points.groupBy(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).agg(F.count("*").alias("c"))
    crowd = cells.agg(F.expr("percentile(c, 0.5, c)")).first()[0]
    radius = max(side * min(1.0, (2 * k / (3.14 * max(crowd, 1.0))) ** 0.5), 1e-12)
    left, done = centers.select("cid", "cx", "cy"), None
    nearest = Window.partitionBy("cid").orderBy("d2", "pid")
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    while True:
        # no more than k points: all of them are near; else a radius past everything holds k
        last = n <= k
        around = left.select(F.col("cid").alias("qid"), "cid", "cx", "cy", (F.col("cx") - radius).alias("lx"), (F.col("cy") - radius).alias("ly"), (F.col("cx") + radius).alias("hx"), (F.col("cy") + radius).alias("hy"))
        pairs = (left.crossJoin(F.broadcast(points.select("pid", "x", "y"))) if last else range_pairs(points.select("pid", "x", "y"), around, closed=True)).withColumn("d2", d2)
        inside = pairs if last else pairs.where(F.col("d2") <= radius * radius)
        ranked = inside.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("cid", "pid", "d2", "rank")
        full = ranked if last else ranked.join(ranked.where(F.col("rank") == k).select("cid"), "cid", "left_semi")
        full = written(full, "nearest")
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        left = written(left.join(full.select("cid").distinct(), "cid", "left_anti"), "centers")
        if left.isEmpty():
            return done
        radius *= 2
