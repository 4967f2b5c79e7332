"""Tables in the folder that all executors see; they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new folder in local mode (tests) and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: later plans start from the files, not from df's lineage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessella/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, as the shuffle files of finished jobs stay on the executors' disks until it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables that go when the block ends, or before by drop(): with Scratch() as keep: t = keep(df, "name")."""

    def __enter__(self):
        self.tables: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(t)
            self.tables = [x for x in self.tables if x is not t]
        if tables:
            release(tables[0].sparkSession)

    def __exit__(self, *error) -> None:
        for t in self.tables:
            remove(t)
