"""Chroma audio fingerprints: packed integers from pitch-class frames, alignment by offset histograms.

Audio is mono PCM.  Frames of FRAME samples (hop HOP) give magnitudes, which fold into 12 pitch classes;
frames are scaled to norm 1.  Over each run of SPAN frames, 16 filters compare the sums of two areas of the
span x 12 image, read from its integral image; each filter's value falls into one of four classes, whose
2-bit Gray codes pack to a 32-bit integer.  A recording's fingerprint is the sequence of these integers.

Matching: recordings with equal fingerprints form a class, carried by the smallest id.  Keys stand for what
changes over a window: the exact pair of an integer and the one SPAN later, and KEY_BITS bits drawn from
KEY_SPAN integers, once from each of four halves of the filters, so that neither whole integers nor all
filters need to be free of errors and chance meetings are rare.  A query class meets every class with which it
shares keys; hits are counted by offset, every offset with LEAST_HITS is aligned over the whole overlap
and the one with the lowest bit error rate stays.  Recall is measured in the tests, against all offsets
of all pairs and by error rate.  Overlaps of fewer than LEAST_OVERLAP integers are no match.  A window
in which fewer than half of the integers differ from the one before (silence, a held note and their borders)
has no key: what recordings share besides is what links them.  A key of very many recordings is dealt over
tasks by the adaptive split of skewed joins.

Defined cases: null, empty and too short recordings have an empty fingerprint, are a class of their own
each and match nothing; silence gives the integer of equal areas; repeated ids count as one recording, the
longest fingerprint; ids may be of any type that sorts; ties in error go to more hits, then to the smaller shift; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import U64, mix, written

RATE = 11025
FRAME, HOP = 1024, 512
LOWEST, HIGHEST = 110.0, 3520.0
SPAN = 8
LEAST_HITS = 2
LEAST_OVERLAP = 16
MOST_ERROR = 0.25
BATCH_ROWS = 64
# Filters: kind, first pitch class, pitch classes, first frame, frames.
FILTERS = [(k, c, h, t, w) for k, (c, h, t, w) in enumerate([(0, 12, 0, 8), (0, 6, 0, 8), (6, 6, 0, 8), (0, 4, 0, 4), (4, 4, 0, 4), (8, 4, 0, 4), (0, 4, 4, 4), (4, 4, 4, 4), (8, 4, 4, 4), (0, 2, 0, 8), (2, 2, 0, 8), (4, 2, 0, 8), (6, 2, 0, 8), (8, 2, 0, 8), (10, 2, 0, 8), (0, 12, 2, 4)])]
CUTS = (-0.08, 0.0, 0.08)
KEY_SPAN, KEY_BITS = 16, 40
_halves = [[f for f in range(16) if ok(f)] for ok in (lambda f: f < 8, lambda f: f >= 8, lambda f: f % 2 == 0, lambda f: f % 2 == 1)]
# For each half of the filters, KEY_BITS places (integer of the window, bit).
PLACES = [sorted(np.random.default_rng(77 + i).permutation([(t, 2 * f + k) for t in range(KEY_SPAN) for f in half for k in (0, 1)])[:KEY_BITS].tolist()) for i, half in enumerate(_halves)]
GRAY = np.array([0, 1, 3, 2], np.uint32)


def pitch_table(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """[bin, pitch class] 0/1 of the spectrum's bins between LOWEST and HIGHEST."""
    out = np.zeros((frame // 2 + 1, 12))
    for i in range(1, len(out)):
        hz = i * rate / frame
        if LOWEST <= hz <= HIGHEST:
            out[i, int(round(12 * np.log2(hz / 440.0))) % 12] = 1
    return out


def chroma(samples: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[frame, 12] pitch-class energies, each frame of norm 1 (0 in silence)."""
    count = (len(samples) - FRAME) // HOP + 1
    if count <= 0:
        return np.zeros((0, 12))
    at = np.arange(count)[:, None] * HOP + np.arange(FRAME)[None, :]
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(FRAME), axis=1)) ** 2 @ table
    norm = np.linalg.norm(power, axis=1, keepdims=True)
    return np.divide(power, norm, out=np.zeros_like(power), where=norm > 1e-9)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers of [frame, 12]; one for each run of SPAN frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t, w, c, h):
        a = total[t + w : t + w + n, c + h] - total[t : t + n, c + h] - total[t + w : t + w + n, c] + total[t : t + n, c]
        return a / (w * h)

    out = np.zeros(n, np.uint32)
    for k, c, h, t, w in FILTERS:
        if k % 2:  # upper against lower pitch classes
            value = area(t, w, c + h // 2, h - h // 2) - area(t, w, c, h // 2)
        else:  # later against earlier frames
            value = area(t + w // 2, w - w // 2, c, h) - area(t, w // 2, c, h)
        out |= GRAY[np.digitize(value, CUTS)] << np.uint32(2 * k)
    return out


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fingerprints(recordings: DataFrame, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """(id, prints): audio is binary, 16-bit little-endian mono PCM at RATE."""

    def run(batches):
        table = pitch_table()
        for b in batches:
            prints = [fingerprint(chroma(np.frombuffer(a[: len(a) // 2 * 2], "<i2").astype(np.float64) / 32768, table)).astype(np.int64).tolist() if a is not None else [] for a in b["audio"]]
            yield pd.DataFrame({"id": b["id"], "prints": prints})

    picked = recordings.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))
    return picked.mapInPandas(run, f"id {_kind(picked, 'id')}, prints array<long>")


def classes(prints: DataFrame) -> DataFrame:
    """(id, class_id, prints): equal fingerprints share the smallest id; empty ones stand alone."""
    one = prints.groupBy("id").agg(F.max(F.struct(F.size("prints").alias("n"), "prints")).alias("x")).select("id", "x.prints")
    key = F.when(F.size("prints") > 0, F.sha2(F.to_json("prints"), 256)).otherwise(F.concat(F.lit("empty "), F.col("id").cast("string")))
    keyed = one.withColumn("k", key)
    least = keyed.groupBy("k").agg(F.min("id").alias("class_id"))
    return keyed.join(least, "k").select("id", "class_id", "prints")


def window_keys(prints: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, places) of fingerprints prints[bounds[i]:bounds[i+1]], of one row each key's first place."""
    n = len(prints)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[1:][row] - np.arange(n)
    moves = np.concatenate([[0, 0], np.cumsum(prints[1:] != prints[:-1])])[-n - 1 :]  # changes up to each integer
    bits = np.unpackbits(prints.astype("<u4").view(np.uint8).reshape(n, 4), axis=1, bitorder="little")
    keys, at = [], []
    m = n - SPAN
    if m > 0:
        ok = np.flatnonzero((left[:m] > SPAN) & (moves[SPAN + 1 : SPAN + 1 + m] - moves[1 : m + 1] >= SPAN // 2))
        keys.append(mix(prints[ok].astype(np.uint64) | (prints[ok + SPAN].astype(np.uint64) << U64(32))))
        at.append(ok)
    m = n - KEY_SPAN + 1
    for i, places in enumerate(PLACES if m > 0 else ()):
        ok = np.flatnonzero((left[:m] >= KEY_SPAN) & (moves[KEY_SPAN : KEY_SPAN + m] - moves[1 : m + 1] >= KEY_SPAN // 2))
        k = np.full(len(ok), U64((i + 1) << KEY_BITS))
        for j, (t, bit) in enumerate(places):
            k |= bits[ok + t, bit].astype(np.uint64) << U64(j)
        keys.append(mix(k))
        at.append(ok)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.lexsort((at, keys, row[at]))
    keys, at = keys[order], at[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[at[1:]] != row[at[:-1]])
    keys, at = keys[first], at[first]
    return keys, row[at], at - bounds[:-1][row[at]]


def keyed(reps: DataFrame) -> DataFrame:
    """(class_id, v, pos): the keys of each class, with their first places."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                b = batch.slice(i, BATCH_ROWS)
                prints = b.column(1)
                bounds = np.concatenate([[0], np.cumsum(prints.value_lengths().to_numpy())])
                keys, row, pos = window_keys(prints.flatten().to_numpy().astype(np.uint32), bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(keys.view(np.int64)), pa.array(pos, pa.int32())], names=["class_id", "v", "pos"])

    return reps.select("class_id", "prints").mapInArrow(run, f"class_id {_kind(reps, 'class_id')}, v long, pos int")


def matches(of: DataFrame, queries: DataFrame, least_hits: int = LEAST_HITS, most_error: float = MOST_ERROR) -> DataFrame:
    """(query_class, class_id, offset, hits, overlap, error) between different classes.

    of: classes' rows; queries: (id) of the query recordings.  offset: frames by which the class starts
    after the query.
    """
    reps = of.where("id = class_id").select("class_id", "prints").where("size(prints) > 0")
    asked = of.join(queries, "id", "left_semi").select("class_id").distinct()
    first = keyed(reps)
    q = keyed(reps.join(asked, "class_id", "left_semi")).select(F.col("class_id").alias("query_class"), "v", F.col("pos").alias("p"))
    hits = q.join(first, "v").where("query_class <> class_id").groupBy("query_class", "class_id", (F.col("p") - F.col("pos")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    tried = hits.where(F.col("hits") >= least_hits).groupBy("query_class", "class_id").agg(F.collect_list("offset").alias("offsets"), F.collect_list("hits").alias("counts"))
    both = tried.join(reps.select(F.col("class_id").alias("query_class"), F.col("prints").alias("a")), "query_class").join(reps.withColumnRenamed("prints", "b"), "class_id")

    def measure(batches):
        for b in batches:
            rows = []
            for query, other, x, y, offsets, counts in zip(b["query_class"], b["class_id"], b["a"], b["b"], b["offsets"], b["counts"], strict=True):
                x, y, found = np.asarray(x, np.uint32), np.asarray(y, np.uint32), []
                for o, hits in zip(offsets, counts, strict=True):
                    p, q = x[max(0, o) :], y[max(0, -o) :]
                    n = min(len(p), len(q))
                    error = float(np.bitwise_count(p[:n] ^ q[:n]).sum()) / (32 * max(1, n))
                    if n >= LEAST_OVERLAP and error <= most_error:
                        found.append((error, -hits, abs(o), o, n))
                if found:
                    error, hits, _, o, n = min(found)
                    rows.append((query, other, o, -hits, n, error))
            yield pd.DataFrame(rows, columns=["query_class", "class_id", "offset", "hits", "overlap", "error"])

    kind = _kind(of, "class_id")
    return both.mapInPandas(measure, f"query_class {kind}, class_id {kind}, offset int, hits long, overlap long, error double")


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, audio): a melody for each vector, a note for each of its components.

    The tables hold no audio, so the query makes some: a component picks one of 24 half-tones, about evenly.
    """
    tone = np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(24)[:, None] / 12) * np.arange(HOP * 2)[None, :] / RATE)
    tone = (tone * 20000).astype("<i2")

    def melody(v):
        if v is None or not len(v):
            return b""
        x = np.nan_to_num(np.asarray(v, np.float64)) * np.sqrt(len(v))  # about standard normal
        return tone[np.minimum(24 / (1 + np.exp(-1.7 * np.clip(x, -20, 20))), 23).astype(int)].tobytes()

    def run(batches):
        for b in batches:
            for at in range(0, len(b), BATCH_ROWS):
                some = b.iloc[at : at + BATCH_ROWS]
                yield pd.DataFrame({"id": some["id"], "audio": [melody(v) for v in some["v"]]})

    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return picked.mapInPandas(run, f"id {_kind(picked, 'id')}, audio binary")


def in_small_batches(spark, act):
    """act() while Arrow batches hold BATCH_ROWS rows, as recordings are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        return act()
    finally:
        spark.conf.set(name, before)


def op4_chroma(spark, sf_dir: str) -> DataFrame:
    """All embeddings as melodies: class of each, and for query ids (divisible by 20) the aligned classes.

    A row per recording: vec_id, class_id, n_prints, is_query, n_links (other classes its class aligns with,
    if the class was asked for), best_class, best_offset, best_error.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints, _ = in_small_batches(spark, lambda: written(fingerprints(render(vectors)), "prints"))
    of, _ = written(classes(prints), "classes")
    queries = of.where("id % 20 = 0").select("id")
    found, _ = written(matches(of, queries), "matches")
    best = found.groupBy("query_class").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct("error", "class_id", "offset")).alias("x"))
    rows = of.join(best, of["class_id"] == best["query_class"], "left")
    return rows.select(F.col("id").alias("vec_id"), "class_id", F.size("prints").cast("long").alias("n_prints"), (F.col("id") % 20 == 0).alias("is_query"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("x.class_id").alias("best_class"), F.col("x.offset").alias("best_offset"), F.round("x.error", 6).alias("best_error"))
