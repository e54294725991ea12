"""A content cache for providers (U3, DF8): each text goes to a provider once for each of its versions.

The cache is a folder of Parquet tables, one for each provider and version, with a row (hash, result) for each text
by the SHA-256 of its content.  A run reduces its texts to distinct ones, leaves out by an anti join those that the
cache holds, sends the rest to the provider in one pass, and appends the results as one commit.  A run that is
broken off before its commit leaves nothing, and two runs at once leave equal rows, of which one counts.

Defined cases: null texts have a null result and are not sent; a provider that gives no row for a text is asked
again by the next run; rows, ids and order of the input do not matter; an empty input sends nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _held(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(hash, result) of what was committed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    schema = f"hash string, result {kind}"
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["hash"])


def with_results(rows: DataFrame, text_col: str, provider: Callable[[DataFrame], DataFrame], kind: str, folder: str, name: str, version: str, out: str = "result") -> DataFrame:
    """rows with the provider's result for their text in column `out`.

    provider: (hash, text) -> (hash, result of SQL type `kind`), at most a row for each hash.
    """
    spark = rows.sparkSession
    path = f"{folder}/{name}/version={version}"
    text = F.col(f"`{text_col}`").cast("string")
    asked = rows.select(text.alias("text")).where("text is not null").select(F.sha2("text", 256).alias("hash"), "text")
    once = asked.groupBy("hash").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    missing = once.join(_held(spark, path, kind).select("hash"), "hash", "left_anti")
    if not missing.isEmpty():
        provider(missing).select("hash", F.col("result").cast(kind).alias("result")).where("hash is not null").write.mode("append").parquet(path)
    found = _held(spark, path, kind).select(F.col("hash").alias("_hash"), F.col("result").alias(out))
    return rows.withColumn("_of", F.sha2(text, 256)).join(found, F.col("_of") == F.col("_hash"), "left").drop("_of", "_hash")


def versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Versions of a provider that the cache holds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p)) if fs.exists(p) else []
