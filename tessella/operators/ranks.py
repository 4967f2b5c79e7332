"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def global_rank(df: DataFrame, order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with the 0-based rank of each row in this order (which should be total), and with the sum of weight up to the row, itself included, as <name>_sum.

    Rows are dealt by ranges of the order and written once; each range is ranked alone and shifted by the
    counts (and sums) of the ranges before it. Only one row per range (as many as shuffle partitions) is broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    weigh = F.lit(0.0) if weight is None else F.col(weight)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("count"), F.sum(weigh).alias("sum"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"), F.coalesce(F.sum("sum").over(ahead), F.lit(0.0)).alias("_sum"))
    own = Window.partitionBy("_range").orderBy(*order)
    ranked = dealt.join(F.broadcast(before), "_range").withColumn(name, (F.row_number().over(own) - 1 + F.col("_before")).cast("bigint"))
    if weight is not None:
        ranked = ranked.withColumn(f"{name}_sum", F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum"))
    return ranked.drop("_range", "_before", "_sum")


def ntile_of(rank: Column, total: Column, tiles: Column) -> Column:
    """0-based NTILE of a 0-based rank: the first total % tiles tiles hold one row more."""
    q, r = F.floor(total / tiles), total % tiles
    long = r * (q + 1)
    return F.when(rank < long, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - long) / F.greatest(q, F.lit(1)))).cast("bigint")
