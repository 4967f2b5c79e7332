"""Helpers shared by the operators: text columns, Arrow maps, the shared folder, worker caches."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import Scratch, release, remove, shared_dir, written

__all__ = ["Scratch", "arrow_map", "ids_and_text", "release", "remove", "shared_dir", "ship", "table", "utf8", "worker_cache", "written"]

#: Rows per Arrow batch that leaves a worker; bounds what a worker holds besides its input batch.
OUT_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (bigint) and the text as bytes, so no extra column can clash or be read."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))


def arrow_map(df: DataFrame, fn, schema: StructType) -> DataFrame:
    """Maps rows to rows in Arrow batches.

    fn(rows) takes an iterator of row tuples in the order of df's columns and yields
    row tuples in the order of schema, so it may hold state over a partition.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        def rows():
            for batch in batches:
                # small slices: Python objects for a few rows at a time only
                step = max(1, min(256, 4_000_000 * batch.num_rows // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held, size = [], 0
        for row in fn(rows()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if len(held) >= OUT_ROWS or size > 4_000_000:
                yield batch_of(held, arrow)
                held, size = [], 0
        if held:
            yield batch_of(held, arrow)

    return df.mapInArrow(run, schema)


def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, also when functions are pickled by value."""
    return sys.__dict__.setdefault("_tessella_worker_cache", {})


def ship(spark: SparkSession, value):
    """Broadcasts a value of bounded size; the result, called in a worker, gives it there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)
