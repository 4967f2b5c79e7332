"""Continuous range counts over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def window_counts(points: DataFrame, windows: DataFrame, *, time: str = "ts", late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """qid, start, cnt: points of a stream (x, y, time) in each of a few windows and tumbling spans; late rows drop past the watermark.

    windows is a small static table and is broadcast by its size's own judgement.
    """
    hit = points.withWatermark(time, late).join(windows, g.contains(g.window(), F.col("x"), F.col("y")))
    return hit.groupBy("qid", F.window(time, span).alias("w")).agg(F.count("*").alias("cnt")).select("qid", F.col("w.start").alias("start"), "cnt")
