"""Extractive summaries by sentence centrality.

A text's sentences are the vertices of a graph; two of them are as near as their words are alike (cosine of word counts
weighted by how few sentences hold a word).  Centrality is the stationary law of a walk that follows near sentences
and starts again with chance 1 - DAMPING, by power iteration.  The matrix of all pairs is never made: a step is
two products with the sparse sentence-word matrix, so the work is linear in the words of a text, however long.

Texts are independent rows: one pass, no shuffle.  The k most central sentences come in the order of the text.

Defined cases: null texts give null; texts without words give no sentences; equal centrality (to 9 places) goes to the
earlier sentence, so that texts whose sentences share nothing give their first ones; a sentence that stands more than
once is taken where it stands first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
DAMPING = 0.85
STEPS = 40
ROWS = 256  # texts of a batch that are held as Python strings at once


def sentences(text: str) -> list[str]:
    """A text's sentences with at least one word, without outer white space, each once."""
    return list(dict.fromkeys(s for m in SENTENCE.finditer(text) if WORD.search(s := m[0].strip())))


def centrality(some: list[str]) -> np.ndarray:
    """The share of each sentence in the walk."""
    n = len(some)
    words: dict[str, int] = {}
    row, col = [], []
    for i, s in enumerate(some):
        for w in WORD.findall(s.lower()):
            row.append(i)
            col.append(words.setdefault(w, len(words)))
    cell, count = np.unique(np.array(row, np.int64) * len(words) + np.array(col, np.int64), return_counts=True)
    row, col = cell // len(words), cell % len(words)
    w = count * np.log(1 + n / np.bincount(col, minlength=len(words)))[col]
    w = w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]

    def near(x: np.ndarray) -> np.ndarray:  # sums of x over all other sentences, by likeness
        return np.bincount(row, w * np.bincount(col, w * x[row], minlength=len(words))[col], minlength=n) - x

    total = near(np.ones(n))
    alone = total < 1e-9
    at = np.full(n, 1 / n)
    for _ in range(STEPS):
        step = near(np.where(alone, 0, at / np.where(alone, 1, total)))
        at = (1 - DAMPING) / n + DAMPING * (np.maximum(step, 0) + at[alone].sum() / n)
    return at


def summary(text: str, k: int) -> list[str]:
    some = sentences(text)
    if len(some) <= k:
        return some
    score = np.round(centrality(some) * len(some), 9)
    return [some[i] for i in np.sort(np.lexsort((np.arange(len(some)), -score))[:k])]


def with_summary(rows: DataFrame, text_col: str = "text", k: int = 3, out: str = "summary") -> DataFrame:
    """rows with their texts' k most central sentences in column `out`."""
    from pyspark.sql import types as T

    kept = [f for f in rows.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        for b in (some.slice(at, ROWS) for some in batches for at in range(0, some.num_rows, ROWS)):
            found = [None if t is None else summary(t, k) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, schema)
