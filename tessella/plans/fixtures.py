"""Points, windows and metric rows over the test tables: DataFrames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(column: str):
    return F.datediff(F.col(column), F.lit("1995-01-01").cast("date")) / F.lit(2500.0)


def pts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), _days("o_orderdate").alias("x"), (F.col("o_totalprice") / F.lit(500000.0)).alias("y"))


def _around(points: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points.select(F.col("pid").alias("qid"), (x - 0.02).alias("lx"), (y - 0.03).alias("ly"), (x + 0.02).alias("hx"), (y + 0.03).alias("hy"))


def win_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(pts_orders(spark, sf_dir).where("pid % 300 = 0"))


def pts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    zone = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), ((us - zone) / F.lit(2592000000000.0)).alias("x"), (F.col("value") / F.lit(1000.0)).alias("y"))


def pts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_days("l_shipdate").alias("x"), (F.col("l_extendedprice") / F.lit(105000.0)).alias("y"))


def pts_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def win_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(pts_embed(spark, sf_dir).where("pid % 25 = 0"))


METRICS = """
select event_id, event_type as model,
  cast(user_id % 3 + 1 as int) as data_sample_num, cast(user_id % 5 + 1 as int) as dataset_entropy_id,
  cast(event_id % 5 + 1 as int) as query_entropy_id,
  cast(case (event_id % 7) % 5 when 0 then 64 when 1 then 256 when 2 then 1024
       when 3 then 4096 else 16384 end as int) as sel_tag,
  cast(case event_id % 8 when 0 then 32 when 1 then 64 when 2 then 128 when 3 then 256 when 4 then 512
       when 5 then 1024 when 6 then 2048 else 4096 end as int) as block_size,
  value * 1000e0 as query_latency,
  value * 1000e0 * (1.5e0 + (event_id % 4) * 0.5e0) as disk_backed_query_latency,
  value * 100e0 as refinement_latency,
  cast(event_id % 997 + 1 as bigint) as result_size,
  cast(event_id % 1997 + 1 as bigint) as number_of_points_scanned,
  (user_id % 11) * 0.25e0 as build_time
from {events}
"""


def metrics_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(METRICS, events=table(spark, sf_dir, "events"))


#: The same views for other engines.
CTE = {
    "pts_orders": "pts_orders as (select o_orderkey as pid, datediff('day', date '1995-01-01', o_orderdate::date) / 2500.0e0 as x, o_totalprice / 500000.0e0 as y from orders)",
    "win_orders": "win_orders as (select pid as qid, x - 0.02e0 as lx, y - 0.03e0 as ly, x + 0.02e0 as hx, y + 0.03e0 as hy from pts_orders where pid % 300 = 0)",
    "pts_events": "pts_events as (select event_id as pid, (epoch_us(ts) - 1704067200000000) / 2592000000000.0e0 as x, value / 1000.0e0 as y from events)",
    "pts_lineitem": "pts_lineitem as (select datediff('day', date '1995-01-01', l_shipdate::date) / 2500.0e0 as x, l_extendedprice / 105000.0e0 as y from lineitem)",
    "pts_embed": "pts_embed as (select vec_id as pid, embedding[1]::double as x, embedding[2]::double as y from embeddings)",
    "win_embed": "win_embed as (select pid as qid, x - 0.02e0 as lx, y - 0.03e0 as ly, x + 0.02e0 as hx, y + 0.03e0 as hy from pts_embed where pid % 25 = 0)",
    "metrics_v": f"metrics_v as ({METRICS.format(events='events')})",
}
NEEDS = {"win_orders": ["pts_orders"], "win_embed": ["pts_embed"]}


def sql(body: str) -> str:
    """The query with the views that it names put before it."""
    names = [n for n in CTE if n in body]
    names = list(dict.fromkeys(m for n in names for m in [*NEEDS.get(n, []), n]))
    views = ", ".join(CTE[n] for n in names)
    body = body.strip()
    if not views:
        return body
    return f"with {views}, {body[4:].lstrip()}" if body.lower().startswith("with") else f"with {views} {body}"
