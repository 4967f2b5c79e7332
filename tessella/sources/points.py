"""Readers and writers of points, windows, trees, entropy tables, metrics and configurations."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema


class EmptySource(ValueError):
    pass


def _text(spark: SparkSession, path: str, ddl: str, sep: str = " ", header: bool = False) -> DataFrame:
    df = spark.read.schema(ddl).option("sep", sep).option("header", header).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if df.isEmpty():
        raise EmptySource(path)
    return df


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """pid, x, y of a text file of `x y` lines; pids are unique, not dense."""
    return _text(spark, path, "x double, y double").select(F.monotonically_increasing_id().alias("pid"), "x", "y")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """qid, lx, ly, hx, hy of a text file of `lx ly hx hy` lines."""
    return _text(spark, path, "lx double, ly double, hx double, hy double").select(F.monotonically_increasing_id().alias("qid"), "lx", "ly", "hx", "hy")


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, "x double, y double", sep=",").select(F.monotonically_increasing_id().alias("cid"), "x", "y")


def read_data_entropy(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, "dataset_entropy_id int, dataset_entropy double")


def read_query_entropy(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, "dataset_entropy_id int, query_entropy_id int, query_entropy double")


def entropy_of(entropies: DataFrame, dataset_entropy_id: int, query_entropy_id: int) -> float:
    """The first row's entropy for both ids; an unknown pair is an error."""
    row = entropies.where((F.col("dataset_entropy_id") == dataset_entropy_id) & (F.col("query_entropy_id") == query_entropy_id)).first()
    if row is None:
        raise KeyError((dataset_entropy_id, query_entropy_id))
    return row["query_entropy"]


def read_lat_lon(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon only: the scan reads two columns however many there are."""
    return spark.read.parquet(path).select(F.col("lat").cast("float"), F.col("lon").cast("float"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of a JSON-lines file, with the derived columns."""
    from ..operators.metrics import derive

    return derive(spark.read.schema(schema.METRICS).json(path))


def read_split_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, dim, value of a binary tree's inner nodes (children 2i + 1 and 2i + 2)."""
    return _text(spark, path, "node_id bigint, dim int, value double")


def read_quad_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, mid_x, mid_y, ordering of a four-way tree's inner nodes (children 4i + 1 to 4i + 4); the first line, the root's box, is skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("line"), parts.alias("p"))
    return lines.where((F.col("line") > 0) & (F.size("p") == 4)).select(F.col("p")[0].cast("bigint").alias("node_id"), F.col("p")[1].cast("double").alias("mid_x"), F.col("p")[2].cast("double").alias("mid_y"), (F.col("p")[3] == "1").alias("ordering"))


def keep_every(df: DataFrame, order: str, n: int, valid=None) -> DataFrame:
    """Every n-th of the valid rows in this order, counted from one; ranks are counted per range of the order."""
    from ..operators.ranks import global_rank

    kept = df if valid is None else df.where(valid)
    return global_rank(kept, [order], "_rank").where(F.col("_rank") % n == n - 1).drop("_rank")


def numbers(places: int, *columns: str):
    return [F.format_string(f"%.{places}f", c).alias(c) for c in columns]


def write_points(df: DataFrame, path: str, places: int = 9) -> None:
    df.select(F.concat_ws(" ", *numbers(places, "x", "y"))).write.text(path)


def write_windows(df: DataFrame, path: str, places: int = 9) -> None:
    df.select(F.concat_ws(" ", *numbers(places, "lx", "ly", "hx", "hy"))).write.text(path)


def write_centers(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(",", *numbers(9, "x", "y"))).write.text(path)


def write_table(df: DataFrame, path: str, header: bool = False) -> None:
    """A text table with blanks between columns: entropy tables, count-window notes (header), split nodes."""
    df.write.option("sep", " ").option("header", header).csv(path)


def write_lat_lon(df: DataFrame, path: str) -> None:
    df.select(F.col("lat").cast("float"), F.col("lon").cast("float")).write.option("compression", "zstd").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True))


def write_layout(layout, path: str, files: int = 64) -> None:
    """The block file: points in block order in range-partitioned files, so that file and row-group bounds prune; and the block table."""
    layout.points.repartitionByRange(files, "block_id").sortWithinPartitions("block_id").write.parquet(f"{path}/block_points")
    layout.meta.write.parquet(f"{path}/block_meta")


def read_layout(spark: SparkSession, path: str):
    from ..operators.layouts import Layout

    return Layout(spark.read.parquet(f"{path}/block_points"), spark.read.parquet(f"{path}/block_meta"))


def text_report(df: DataFrame, limit: int = 1000) -> str:
    """A small result as aligned text."""
    rows = [df.columns, *([str(v) for v in r] for r in df.limit(limit).collect())]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in rows)


def latex_table(df: DataFrame, limit: int = 1000) -> str:
    rows = [" & ".join(df.columns), *(" & ".join(str(v) for v in r) for r in df.limit(limit).collect())]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + " \\\\\n".join(rows) + " \\\\\n\\end{tabular}\n"


@dataclass(frozen=True)
class Config:
    """One profile of an experiment configuration."""

    name: str
    values: dict = field(default_factory=dict)
    block_sizes: tuple[int, ...] = ()

    def __getitem__(self, key: str):
        return self.values[key]


def read_config(path: str, profile: str | None = None) -> Config:
    """A profile by name, else by the environment's EXPERIMENT_NAME, else by the file's default, else synthetic."""
    data = json.loads(Path(path).read_text())
    name = profile or os.environ.get("EXPERIMENT_NAME") or data.get("default_experiment") or "synthetic"
    profiles = data.get("experiments", data)
    if name not in profiles:
        raise KeyError(f"no profile {name}")
    return Config(name, dict(profiles[name]), tuple(data.get("block_sizes", profiles[name].get("block_sizes", ()))))


def task_matrix(spark: SparkSession, data_entropies: list[int], samples: list[int], block_sizes: list[int], selectivities: list[str], query_entropies: list[int]) -> DataFrame:
    """Every combination of settings with a task_id from 1, the last setting fastest."""
    settings = {"data_entropy_id": data_entropies, "sample_num": samples, "block_size": block_sizes, "selectivity": selectivities, "query_entropy_id": query_entropies}
    out = spark.range(1).select()
    for name, values in settings.items():
        # one row that grows: a cross product without a join
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.withColumn("task_id", F.row_number().over(Window.orderBy(*settings)).cast("bigint"))
