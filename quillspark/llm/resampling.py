"""Importance resampling towards a target text: hashed n-gram weights, Gumbel scores, exact top share.

Features are runs of 1 to `max_n` consecutive words, hashed to `buckets` by the crc32 of their bytes.  Every
task counts the buckets of its texts in one array, so that a frequent word costs one number a task; the
driver sees `buckets` sums and sends back one gain for each.  A document's weight is the sum of its
features' gains, read from that array; a Gumbel variate of its id, in thousandths, makes the score.

Scores are integers, so the exact order needs no sort of documents: the histogram of scores, in score
ranges, gives each score the number of documents above it (suffix sums: totals of ranges, then a running
sum inside each) and the cutoff score.  Only documents at or above the cutoff are numbered, by row_number
in the order of ids inside each score.  They are range-partitioned by score, id and row, and counted by
score and piece first, so that a score that very many documents share is numbered in several tasks.

Defined cases: null and empty texts have no words, weight 0, and are never drawn; a null id hashes as the
empty string and stands after all others among equal scores; rows that repeat an id are rows of their own, with one
variate; equal rows of one id are told apart by their place in the written table; an empty table gives no rows, an
empty target gives finite gains; ids may be of any type that sorts; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import LOWER, binary_rows, sub_batches, text_buffer, tidy, word_bounds, written

MAX_N = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
LONG_BYTES = 64
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
#: Everything but 0-9, A-Z, a-z and the bytes of characters beyond ASCII.
NO_WORD = np.ones(256, bool)
NO_WORD[0x30:0x3A] = NO_WORD[0x41:0x5B] = NO_WORD[0x61:0x7B] = NO_WORD[0x80:] = False


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span of bytes: all spans advance a byte at a time, the longest alone at the end."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(size > LONG_BYTES)
    raw = data.tobytes() if len(long) else b""
    for i in long.tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    short = np.flatnonzero(size <= LONG_BYTES)
    short = short[np.argsort(-size[short], kind="stable")]
    at, crc = starts[short], np.full(len(short), 0xFFFFFFFF, np.uint32)
    left = np.searchsorted(-size[short], -np.arange(1, LONG_BYTES + 1), side="right")  # spans of at least so many bytes
    for step, n in enumerate(left.tolist()):
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + step]) & 0xFF] ^ (crc[:n] >> 8)
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def text_buckets(data: np.ndarray, offs: np.ndarray, max_n: int, buckets: int):
    """(words of each row, bucket of each feature, bounds of the rows' features)."""
    data = LOWER.astype(np.uint8)[data]
    starts, ends, first = word_bounds(data, offs, NO_WORD)
    n_words = np.diff(first)
    if max_n > 1:  # words joined by one space, so that a run of words is a span
        size = ends - starts + 1
        to = np.cumsum(size)
        joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
        put = np.ones(len(joined), bool)
        put[to - 1] = False
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        joined[put] = data[np.cumsum(inside[:-1]) > 0]
        data, starts, ends = joined, to - size, to - 1
    row = np.repeat(np.arange(len(n_words)), n_words)
    rows, found = [], []
    for n in range(1, max_n + 1):
        total = len(starts) - n + 1
        if total <= 0:
            break
        ok = np.flatnonzero(row[:total] == row[n - 1 :])
        found.append(crc32_spans(data, starts[ok], ends[ok + n - 1]) % np.uint32(buckets))
        rows.append(row[ok])
    rows, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found))
    if max_n > 1:
        order = np.argsort(rows, kind="stable")
        rows, found = rows[order], found[order]
    return n_words, found, np.searchsorted(rows, np.arange(len(n_words) + 1))


def features(docs: DataFrame, id_col: str, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets: the features' buckets as little-endian integers)."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for b in sub_batches(batches):
            n_words, found, bounds = text_buckets(*text_buffer(b.column(1)), max_n, buckets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(np.diff(bounds), pa.int64()), binary_rows(found.astype(width), bounds)], names=["doc_id", "n_words", "n_features", "buckets"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array, width: str) -> np.ndarray:
    """All numbers of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), width)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; one array a task, one row a bucket and task in the exchange."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0), width), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: thousandths of the log ratio of its smoothed shares, rounded down."""
    total_s, total_t, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + n) / ((s + 1) * (total_t + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): gains read from the array and summed."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[_flat(b.column(3), width)])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums[ends] - sums[ends - n], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int) -> F.Column:
    """A Gumbel variate of the id in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def histogram(scored: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((score, n, above): how many rows have a score and how many a greater one; (range, its rows) in order).

    Distinct scores lie in ranges, the greatest first; the driver sees one total a range.
    """
    spark = scored.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranged, _ = written(counts.repartitionByRange(pieces, F.col("score").desc()).withColumn("part", F.spark_partition_id()), "histogram")
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(before, "part int, base long"))  # a row for each range
    run = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(base, "part").select("part", "score", "n", (F.col("base") + F.sum("n").over(run) - F.col("n")).alias("above")), totals


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """scored (doc_id, score, eligible, ...) -> rank 1 to `draw` by score, smaller ids first; null for the rest."""
    spark = scored.sparkSession
    out = [*scored.columns, "rank"]
    none = F.lit(None).cast("long").alias("rank")
    if draw <= 0:
        return scored.select("*", none)
    scored, _ = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    chosen = scored.where("eligible")
    above, totals = histogram(chosen.select("score"))
    at, part = 0, None
    for part, n in totals:  # noqa: B007  the range that holds the cutoff
        if at + n >= draw:
            break
        at += n
    cutoff = above.where((F.col("part") == part) & (F.col("above") < draw)).agg(F.min("score")).collect()[0][0]
    left = chosen.where(F.col("score") >= cutoff)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartitionByRange(pieces, F.col("score").desc(), F.col("doc_id").isNull(), "doc_id", "_row")
    left, _ = written(left.withColumn("piece", F.spark_partition_id()), "surviving")
    held = left.groupBy("score", "piece").agg(F.count(F.lit(1)).alias("here"))  # a score in several pieces only where ranges meet
    earlier = F.sum("here").over(Window.partitionBy("score").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    base = held.withColumn("earlier", earlier).join(above.select("score", "above"), "score").select(F.col("score").alias("_s"), F.col("piece").alias("_p"), (F.col("above") + F.col("earlier")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("score", "piece").orderBy(F.col("doc_id").isNull(), "doc_id", "_row"))
    top = left.withColumn("nth", nth).join(base, (F.col("score") == F.col("_s")) & (F.col("piece") == F.col("_p")))
    place = (F.col("base") + F.col("nth")).cast("long")
    top = top.withColumn("rank", F.when(place <= draw, place)).select(*out)
    return top.unionByName(scored.where(~F.col("eligible") | (F.col("score") < cutoff)).select("*", none).select(*out))


def resample(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_text="text", max_n=MAX_N, buckets=BUCKETS, percent=PERCENT, least_words=LEAST_WORDS, seed=SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of docs."""
    found, _ = written(features(docs, id_col, text_col, max_n, buckets), "features")
    goal = features(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), "_id", "_text", max_n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(goal, buckets))
    eligible = F.col("n_words") >= least_words
    scored = weighted(found, gain).withColumn("eligible", eligible).withColumn("score", F.col("weight") + gumbel(seed))
    draw = found.where(eligible).count() * percent // 100
    return ranked(scored, draw).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns; ids are taken to be a key here."""
    chosen = resample(docs, target, id_col, **settings).where("rank is not null").select(F.col("doc_id").alias(id_col))
    return docs.join(chosen, id_col, "left_semi")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Contract query: a tenth of the documents drawn towards the benchmark's words."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
d AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM dw) GROUP BY doc_id, word),
v AS (SELECT word, list_transform(range(0, CAST(length(hex(encode(word))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT word FROM d UNION SELECT word FROM bw)),
k AS (SELECT word, xor(4294967295, list_reduce(b, lambda c, y: list_reduce(range(0, 8), lambda q, i: CASE WHEN (q & 1) = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END, xor(c, y)), 4294967295)) % 10000 AS bucket FROM v),
s AS (SELECT bucket, sum(n) AS s FROM d JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + 10000 AS zs, (SELECT coalesce(sum(t), 0) FROM t) + 10000 AS zt),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * zs AS DOUBLE) / CAST((coalesce(s, 0) + 1) * zt AS DOUBLE))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
e AS (SELECT doc_id, sum(n * gain) AS weight FROM d JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
 CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM dw LEFT JOIN e USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= 20)
SELECT f.*, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)
"""
