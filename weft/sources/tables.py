"""Tables of a folder, and tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches; one of this machine only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there: the plan starts anew and outlives lost executors.

    keep: gets the path, for drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that cut() wrote and that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
