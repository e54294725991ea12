"""Sinks (SNK3, SNK5-SNK8); logs are in operators.research, graph tables in operators.graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_path(run_id: str, record_id: Column, suffix: str) -> Column:
    """SNK6: the path of a record's artifact below a run's folder."""
    return F.concat(F.lit(f"{run_id}/sources/"), record_id, F.lit(f".{suffix}"))


def write_texts(records: DataFrame, out: str, id_col: str = "id", text_col: str = "text") -> None:
    """SNK6: one folder for each record, written by the executors."""
    records.select(F.col(id_col).alias("id"), F.col(text_col).alias("value")).write.partitionBy("id").mode("overwrite").text(out)


def write_json(rows: DataFrame, out: str, wrap: str | None = None) -> None:
    """SNK7: rows as JSON lines, or with `wrap` one object holding a list (bounded by a run's sources)."""
    rows = rows.select(F.struct("*").alias("r"))
    if wrap:
        rows.agg(F.to_json(F.struct(F.collect_list("r").alias(wrap))).alias("value")).write.mode("overwrite").text(out)
    else:
        rows.select(F.to_json("r").alias("value")).write.mode("overwrite").text(out)


def write_report(lines: DataFrame, out: str) -> None:
    """SNK8: a report's lines in order, as one text file."""
    lines.orderBy("section", "n", "k").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(out)


def collection_name(url: Column) -> Column:
    """P6, SNK5."""
    return F.concat(F.lit("graphrag_"), F.substring(F.sha2(url, 256), 1, 16))


def save_collection(chunks: DataFrame, name: str, buckets: int = 16) -> None:
    """SNK3, SNK5: a table bucketed by document, so that later joins on it need no shuffle."""
    chunks.write.bucketBy(buckets, "document_id").sortBy("document_id").mode("overwrite").saveAsTable(name)
