"""Merged tables and stateful streams: batches, replays, restarts, compaction, idle state."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, merged
from quillspark.streaming import incremental


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merged_table_equals_a_dict(spark, tmp_path):
    """Random batches with null keys, repeated keys, deletions, replays, gaps and compactions."""
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    schema = spark.createDataFrame([], "k string, n long, v double").schema
    merged.create(spark, path, schema, ["k", "n"], buckets=4)
    merged.create(spark, path, schema, ["other"])  # it is there
    assert rows(merged.read(spark, path)) == []
    for number in (0, 1, 3, 4, 9):
        batch = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([None, rng.random()]), i, rng.random() < 0.3) for i in range(rng.choice([0, 6, 12]))]
        df = spark.createDataFrame(batch, "k string, n long, v double, at long, gone boolean").repartition(3)
        for _ in range(2):
            assert merged.write_batch(df, path, number, "at", F.col("gone"))
        for k, n, v, _, gone in batch:
            want.pop((k, n), None)
            if not gone:
                want[k, n] = v
        assert rows(merged.read(spark, path)) == sorted(((*k, v) for k, v in want.items()), key=str)
        if number == 3:
            assert merged.compact(spark, path) == 3 and merged.pending(spark, path) == 0
            assert not merged.write_batch(df.limit(0), path, 1, "at")  # the base holds it
            assert sorted(os.listdir(path + "/changes")) == []
    some = spark.createDataFrame([(None, None), ("a", 2), ("z", 1)], "k string, n long")
    assert rows(merged.read(spark, path, only=some)) == sorted(((*k, v) for k, v in want.items() if k in [(None, None), ("a", 2)]), key=str)
    merged.compact(spark, path)
    assert rows(merged.read(spark, path)) == sorted(((*k, v) for k, v in want.items()), key=str)
    assert merged.compact(spark, path) in (9, None) and len(os.listdir(path + "/base")) == 1


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    big = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    merged.create(spark, path, big.schema, ["id"], buckets=4)
    merged.write_batch(big, path, 0)
    merged.compact(spark, path)
    base = size(path)
    merged.write_batch(spark.range(50, 150).select("id", F.lit("new").alias("v")), path, 1)
    assert size(path) - base < base / 50
    got = merged.read(spark, path)
    assert got.count() == 200_000 and got.where("v = 'new'").count() == 100
    plan = merged.read(spark, path, only=spark.createDataFrame([(77,)], "id long"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (=|IN)", plan)


def test_what_was_not_committed_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    merged.create(spark, path, one.schema, ["id"])
    merged.write_batch(one, path, 0)
    merged.write_batch(one.withColumn("v", F.lit("lost")), path, 1)
    os.remove(f"{path}/changes/batch=1/_SUCCESS")
    assert rows(merged.read(spark, path)) == [(1, "a")]
    merged.write_batch(one.withColumn("v", F.lit("b")), path, 1)
    assert rows(merged.read(spark, path)) == [(1, "b")]


def test_upsert_takes_a_stated_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 3), (2, "z", 2), (3, "c", 1)], "id long, v string, at long")
    assert rows(graph.upsert(old, new, ["id"], "at")) == [(1, "a"), (2, "y"), (3, "c")]
    assert rows(graph.upsert(old, new.drop("at"), ["id"])) == [(1, "a"), (2, "z"), (3, "c")]


def test_ingest_over_three_batches_and_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in "soc")
    schema = "id long, v string"

    def run(batch):
        if batch is not None:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = incremental.ingest(stream, lambda b: b, out, ["id"], check, compact_after=1).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(merged.read(spark, out))

    assert run([(1, "a"), (2, "a")]) == [(1, "a"), (2, "a")]
    assert run([(2, "b"), (3, "b")]) == [(1, "a"), (2, "b"), (3, "b")]
    assert run(None) == [(1, "a"), (2, "b"), (3, "b")]  # a restart without news
    # a batch whose commit is lost is run again from the checkpoint
    last = sorted(os.listdir(check + "/commits"), key=lambda x: (len(x), x))[-1]
    os.remove(f"{check}/commits/{last}")
    assert run([(1, "c")]) == [(1, "c"), (2, "b"), (3, "b")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    incremental.state_store(spark)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_pacing_restarts_and_forgets_idle_domains(rocks, tmp_path):
    spark = rocks
    src, out, check = (str(tmp_path / x) for x in "soc")
    schema = "domain string, url string, ts double"

    def run(batch, idle):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = incremental.paced(stream, 1.0, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(once=True).start()  # with timers, availableNow goes on
        q.awaitTermination()
        return {r["url"]: r["at"] for r in spark.read.parquet(out).collect()}

    idle = 20.0
    got = run([("a", "u2", 0.2), ("a", "u1", 0.0), ("b", "u3", 0.1)], idle)
    assert got == {"u1": 0.0, "u2": 1.0, "u3": 0.1}
    assert run([("a", "u4", 0.3)], idle)["u4"] == 2.0  # state from the checkpoint
    held = lambda: {r["key"]["domain"] for r in spark.read.format("statestore").option("stateVarName", "last").load(check).select("key").collect()}
    assert held() == {"a", "b"}
    time.sleep(idle + 1)
    assert run([("c", "u5", 0.4)], idle)["u5"] == 0.4
    assert held() == {"c"}  # a and b were idle
    assert run([("a", "u6", 0.5)], idle)["u6"] == 0.5
