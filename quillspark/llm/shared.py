"""Shared storage, Arrow text buffers and hashing for the corpus operators.

Hashing works on whole Arrow buffers with numpy.  Words are hashed by tabulation: every byte value has a
random 64-bit number for each of PLACES places in a word, a word's numbers are summed and mixed, and
longer words sum the mixed hashes of their pieces.  So words that differ meet by chance only, whatever
their structure.  Two lanes of independent tables give 128 bits.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.storage import shared_folder

SUB_BATCH_BYTES = 2 << 20
U64 = np.uint64


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def identified(docs: DataFrame, id_col: str, text_col: str, others: bool = False) -> DataFrame:
    """(rid, doc_id, text) with a long rid in the order of ids, nulls last; with `others`, (rid, doc: all columns).

    rid is the id itself where that is a key of integers; else a row's place in the order of ids, then of hashes of
    the texts and of whole rows, from 0 on.  It belongs to the row, not to the run: only rows that are equal in
    every column may change places.  Rows are written, and the driver sees one count a range.
    """
    content = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if others else []
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *content)
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        ids = picked.select("doc_id")
        if ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
            return picked.withColumn("rid", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    whole = [F.xxhash64(F.to_json("doc"))] if others else []
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), *whole, F.col("_at")]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = picked.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(spread, *order).sortWithinPartitions(*order).drop("_at")
    rows, _ = written(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    base, at = [], 0
    for r in sorted(rows.groupBy(part).count().collect()):
        base.append((r["_part"], at))
        at += r["count"]
    base = F.broadcast(spark.createDataFrame(base, "_part int, _base long"))  # a row for each range
    return rows.withColumn("_part", part).join(base, "_part").withColumn("rid", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_at")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def tidy() -> None:
    """Give a worker's freed memory back to the system, at the end of a task's work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- text buffers -------------------------------------------------------------------------------

PLACES = 64
_rng = np.random.default_rng(20240229)
TABLES = _rng.integers(0, 2**64, (2, PLACES, 256), dtype=np.uint64)
MULTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def sub_batches(batches, column: str = "text", limit: int = SUB_BATCH_BYTES):
    """Cut Arrow batches so that each holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, offs: np.ndarray, is_gap: np.ndarray = SPACE):
    """(starts, ends, first): byte bounds of the words and each row's first word, with the total last."""
    n = len(data)
    inside = ~is_gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


@cache
def _table(lower: bool, lane: int) -> np.ndarray:
    """[place * 256 + byte]: white space counts as nothing."""
    out = (TABLES[lane][:, LOWER] if lower else TABLES[lane]).copy()
    out[:, SPACE] = 0
    return out.reshape(-1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, letters A-Z lowered if asked; lanes are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pieces = -(-(ends - starts) // PLACES)
    at = starts
    if long := int(pieces.max()) > 1:
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(starts, pieces) + nth * PLACES
    place = np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64)[at[0] :]
    place -= np.repeat(at.astype(place.dtype), np.diff(np.append(at, len(data))))
    cell = ((place & (PLACES - 1)) << 8) | data[at[0] :]
    h = np.add.reduceat(_table(lower, lane)[cell], at - at[0])
    if long:
        h = np.add.reduceat(mix(h + nth.astype(np.uint64) * MULTS[2]), np.cumsum(pieces) - pieces)
        return mix(h + pieces.astype(np.uint64) * MULTS[3])
    return mix(mix(h) + MULTS[3])


def windows(words: np.ndarray, first: np.ndarray, width: int):
    """(hashes, rows, positions) of all windows of `width` words inside one row."""
    total = len(words) - width + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words[:total] * MULTS[0]
    for j in range(1, width):
        h += words[j : j + total] * MULTS[j]
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)[:total]
    pos = np.arange(total) - first[row]
    ok = pos + width <= counts[row]
    return mix(h[ok]), row[ok], pos[ok]


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5):
    """(hashes, rows) of each row's shingles; shorter rows give all words as one."""
    h, row, _ = windows(words, first, width)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            some = counts[short] > j
            whole[some] += words[first[short[some]] + j] * MULTS[j]
        whole += counts[short].astype(np.uint64) * MULTS[63]
        h, row = np.concatenate([h, mix(whole)]), np.concatenate([row, short])
    return h, row


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int = 5, other: np.ndarray | None = None):
    """(hashes, rows[, other lane's hashes]): each row's distinct shingles, sorted."""
    h, row = shingles(words, first, width)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    if other is None:
        return h[keep], row[keep]
    return h[keep], row[keep], shingles(other, first, width)[0][order][keep]


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
