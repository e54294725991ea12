"""ST1-ST4: running folds, per-domain pacing, continuous ingestion and alert history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import alerts, merged


def running_findings(findings: DataFrame) -> DataFrame:
    """ST1: counts per file and kind as results arrive (complete or update mode)."""
    return findings.groupBy("file", "vuln_type").agg(F.count(F.lit(1)).alias("findings"))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and event-time window; later rows than `late` are dropped."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class Pacer(StatefulProcessor):
    """A domain's last time as value state that lives for `idle` after its last request; a timer clears it then."""

    def __init__(self, gap: float, idle: float):
        self.gap, self.idle = gap, int(1000 * idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double", self.idle)
        self.until = handle.getValueState("until", "ms bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else float("-inf")
        asked = pd.concat(list(rows)).sort_values(["ts", "url"])
        at = []
        for ts in asked["ts"]:
            last = max(ts, last + self.gap)
            at.append(last)
        self.last.update((last,))
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        until = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(until)
        self.until.update((until,))
        yield pd.DataFrame({"domain": key[0], "url": asked["url"].to_numpy(), "at": at})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.until.clear()
        return iter(())


def paced(requests: DataFrame, gap: float = 1.0, idle: float = 3600.0) -> DataFrame:
    """ST2, W7: (domain, url, at): when each request may go, at least `gap` seconds after its domain's last.

    requests: (domain, url, ts seconds).  A domain without requests for `idle` seconds of processing time is
    forgotten.  Needs the RocksDB state store (`state_store`).
    """
    return requests.select("domain", "url", "ts").groupBy("domain").transformWithStateInPandas(Pacer(gap, idle), "domain string, url string, at double", "append", "ProcessingTime")


def state_store(spark: SparkSession) -> None:
    """Streams started from now on keep state in RocksDB, which spills to disk and holds timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, keys: list[str], checkpoint: str, order: str | None = None, deleted: Column | None = None, compact_after: int = 16):
    """ST3: each batch is transformed and committed to the merged table at `path` (see operators.merged).

    A batch writes its own rows; one that is run again gives the same table.  The table is compacted when more
    than `compact_after` batches wait.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, transform(batch)
        merged.create(spark, path, new.drop(*([order] if order else [])).schema, keys)
        merged.write_batch(new, path, number, order, deleted)
        if merged.pending(spark, path) > compact_after:
            merged.compact(spark, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def alert_history(stream: DataFrame, path: str, checkpoint: str):
    """ST4: classified alerts appended to a table."""
    return alerts.classify(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
