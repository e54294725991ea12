"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Every stage takes null, empty, very long and repeated texts, null and repeated ids, null sources and empty
tables: texts that are null or without letters leave with the first stage; one row of each group of equal
or near texts stays; a row with a null id is a row like others; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontaminate import drop_leaks
from quillspark.llm.langid import keep_known
from quillspark.llm.mixing import mixed_documents
from quillspark.llm.neardup import keep_one
from quillspark.llm.shared import new_folder
from quillspark.llm.tokenstream import stream_digest


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; `und` and what lies below the classifier's limits goes."""
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix's shards drew, shard by shard: a row for each block of at most 1,024 words, so that a
    longer document comes as several rows of one id, and a document of two passes twice."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix written as a token stream; a row per document as the files hold it."""
    return stream_digest(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None  # the stages learn, draw and encode; SQL can't express them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}") + "/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
