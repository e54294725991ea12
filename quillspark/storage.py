"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """df written as Parquet in the shared folder and read back; the files go when the driver's JVM ends.  rows: at most so many a file,
    where rows are so large that a reader must not take those of a whole file at once."""
    spark = df.sparkSession
    path = scratch(spark, "cut") + "/t"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
