"""Schemas of the engine's tables."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _of(**columns) -> StructType:
    return StructType([StructField(name, kind()) if isinstance(kind, type) else StructField(name, kind) for name, kind in columns.items()])


POINTS = _of(pid=LongType, x=DoubleType, y=DoubleType)
WINDOWS = _of(qid=LongType, lx=DoubleType, ly=DoubleType, hx=DoubleType, hy=DoubleType)
BLOCK_META = _of(block_id=LongType, x_lo=DoubleType, y_lo=DoubleType, x_hi=DoubleType, y_hi=DoubleType, n=LongType)
LAT_LON = _of(lat=FloatType, lon=FloatType)
GRID = _of(cx=IntegerType, cy=IntegerType, cnt=LongType)
NODES = _of(node_id=LongType, dim=IntegerType, value=DoubleType)
METRICS = _of(
    block_size=IntegerType, build_time=DoubleType, data_sample_num=IntegerType, dataset_entropy=DoubleType, dataset_entropy_id=IntegerType, query_entropy=DoubleType, query_entropy_id=IntegerType,
    selectivity=StringType, model=StringType, query_latency=LongType, result_size=LongType, refinement_latency=LongType, number_of_refined_blocks=DoubleType, number_blocks_in_blockstore=LongType,
    number_of_points_scanned=DoubleType, block_size_quantiles=ArrayType(LongType()), disk_backed_result_size=LongType, disk_backed_query_latency=LongType, area_or_count_based=StringType,
)
