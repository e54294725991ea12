"""Language identification with string kernels.

A text's blended spectrum is the set of its byte n-grams of orders 1 to 4, hashed to `BUCKETS` places;
the kernel of two texts is the number of places both hold, over the root of the product of their
numbers.  Nystroem landmarks (a few training texts per language) turn the kernel into features; one
ridge regression per language against the rest is fitted on them, and its weights are folded into one
matrix, so that a batch of texts is scored by two matrix products.

A filter needs to know what belongs to no learned language.  Two limits come from the training sample: a
score halfway between chance (one over the number of languages) and the lowest thousandth of rightly
classified rows, and half of the lowest thousandth of kernel values with the nearest landmark of another row.
Texts below either are rejected: unlearned scripts hold next to no n-gram of any landmark.

Training reads a bounded sample: at most `per_lang` rows of each language, by hash order.  The sample's
spectra (2 KB a row) are computed on the executors; the fit on the driver is bounded by the sample.

Defined cases: a null text, or one without any letter, gives `und` with score 0; very long texts count
whole; rows with null lang are never learned from; without any labelled row everything is `und`;
a row's language and text are learned together whatever its id, equal rows once; ids may be null, repeated and of any
type that sorts; extra columns have no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import sub_batches, text_buffer, tidy

BITS = 14
BUCKETS = 1 << BITS
ORDERS = 4
PER_LANG = 800
LANDMARKS = 128
RIDGE = 1e-2
CHUNK = 256
LOW = 0.001
# Multipliers of the n-gram hash, one for each place in the gram.
GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LOWERED = np.arange(256, dtype=np.uint32)
LOWERED[0x41:0x5B] += 32


def spectra(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[row, bucket] 0/1: the n-grams that each row's bytes hold."""
    rows = len(offs) - 1
    out = np.zeros(rows * BUCKETS, np.uint8)
    place = np.repeat(np.arange(rows, dtype=np.int64) << BITS, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(data))
    b = LOWERED[data] + np.uint32(1)
    h = np.zeros(len(data), np.uint32)
    for n in range(ORDERS):
        m = len(data) - n
        if m <= 0:
            break
        h = h[:m] + b[n:] * GRAM[n]
        g = h * np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(15)
        g = (g * np.uint32(0x297A2D39) + np.uint32(n * 0x1B873593)) >> np.uint32(32 - BITS)
        ok = left[:m] > n
        out[place[:m][ok] + g[ok]] = 1
    return out.reshape(rows, BUCKETS)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Landmark spectra and the folded weights [landmark, language]."""

    def __init__(self, langs: list[str], marks: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.marks, self.weights, self.bias = langs, marks, weights, bias
        self.least_score = self.least_kernel = 0.0  # below either a text is of no learned language

    def kernel(self, x: np.ndarray) -> np.ndarray:
        z = self.marks.astype(np.float32)
        x = x.astype(np.float32)
        norm = np.sqrt(np.maximum(1, x.sum(1))[:, None] * np.maximum(1, z.sum(1))[None, :])
        return (x @ z.T) / norm

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights + self.bias


def fit(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 11) -> Model:
    """x: [row, bucket] 0/1; y: language of each row."""
    langs = sorted(set(y))
    y_at = np.array([langs.index(v) for v in y])
    rng = np.random.default_rng(seed)
    each = max(1, landmarks // len(langs))
    picked = np.concatenate([rng.permutation(np.flatnonzero(y_at == k))[:each] for k in range(len(langs))])
    model = Model(langs, x[picked], np.zeros((len(picked), len(langs))), np.zeros(len(langs)))
    k_nm = np.concatenate([model.kernel(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]).astype(np.float64)
    value, vector = np.linalg.eigh(k_nm[picked])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    want = np.where(y_at[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    share = np.bincount(y_at, minlength=len(langs))[y_at]
    w = (1 / share)[:, None]  # each language weighs the same
    mean_phi, mean_y = (w * phi).sum(0) / w.sum(), (w * want).sum(0) / w.sum()
    a = (phi - mean_phi).T @ (w * (phi - mean_phi)) / len(langs)
    beta = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), (phi - mean_phi).T @ (w * (want - mean_y)) / len(langs))
    out = Model(langs, x[picked], (root @ beta).astype(np.float32), (mean_y - mean_phi @ beta).astype(np.float32))
    scores = k_nm @ out.weights + out.bias
    right = np.clip((scores.max(1)[scores.argmax(1) == y_at] + 1) / 2, 0, 1)
    others = np.setdiff1d(np.arange(len(x)), picked)
    if len(right) and len(others):
        out.least_score = float(1 / len(langs) + (np.quantile(right, LOW) - 1 / len(langs)) / 2)
        out.least_kernel = float(np.quantile(k_nm[others].max(1), LOW) / 2)
    return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[np.ndarray, list[str]]:
    """Spectra and languages of at most per_lang rows of each language."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "th")
    t = F.col(text_col).cast("string")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), t.alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(t).alias("th")).where("lang is not null and text is not null")
    # a hash range of each language is wide enough for its sample and keeps large ones out of one task
    counts = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    if counts:
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_lang + 100) / n))])
        ids = ids.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    ids = ids.groupBy("lang", "h", "doc_id", "th").agg(F.first("text").alias("text"))  # equal rows are one
    picked = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("lang", "text")

    def pack(batches):
        for b in sub_batches(batches, limit=1 << 20):
            data, offs = text_buffer(b.column(b.schema.get_field_index("text")))
            rows = [np.packbits(spectra(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))).tobytes() for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("lang")), pa.array(rows, pa.binary())], names=["lang", "bits"])

    # at most per_lang rows a language
    rows = picked.mapInArrow(pack, "lang string, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows], np.uint8).reshape(len(rows), BUCKETS)
    return x, [r["lang"] for r in rows]


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = PER_LANG) -> Model | None:
    x, y = sample(docs, id_col, text_col, lang_col, per_lang)
    filled = x.sum(1) > 0 if len(x) else np.zeros(0, bool)
    return fit(x[filled], [v for v, ok in zip(y, filled, strict=True) if ok]) if filled.any() else None


def best(model: Model | None, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language's number or -1 for und, score, kernel with the nearest landmark) of each row of a text buffer."""
    rows = len(offs) - 1
    if model is None:
        return np.full(rows, -1), np.zeros(rows), np.zeros(rows)
    top, conf, near = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    for i in range(0, rows, CHUNK):
        j = min(rows, i + CHUNK)
        k = model.kernel(spectra(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
        s = k @ model.weights + model.bias
        top[i:j], near[i:j] = s.argmax(1), k.max(1)
        conf[i:j] = np.clip((s.max(1) + 1) / 2, 0, 1)
    known = has_letter(data, offs)
    return np.where(known, top, -1), np.where(known, conf, 0.0), near


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    names = np.array([*(model.langs if model is not None else []), "und"], object)

    def score(batches):
        for b in sub_batches(batches):
            top, conf, _ = best(model, *text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[top], pa.string()), pa.array(conf)], names=["doc_id", "lang_pred", "score"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def remainder(column, n: int):
    """crc32 of an id's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned from the rows whose remainder by 5 is not 0, applied to all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of a learned language: `und` and texts below the model's limits go.  No shuffle."""
    model = train(docs, text_col=text_col, **options)

    def run(batches):
        for b in sub_batches(batches, text_col):
            top, conf, near = best(model, *text_buffer(b.column(b.schema.get_field_index(text_col))))
            ok = top >= 0
            if model is not None:
                ok &= (conf >= model.least_score) & (near >= model.least_kernel)
            yield b.filter(pa.array(ok))
        tidy()

    return docs.mapInArrow(run, docs.schema)
