"""Chunks of documents (S1, P5, W3) and context budgets (W5, AG11)."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 200
# Break marks in the order in which they are tried.
BREAKS = (". ", ".\n", "\n\n", "\n")


def boundaries(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[begin, end) of each window.

    All places of the break marks are found once.  A window of full size ends behind the last mark of the
    first kind that has one in the window's last `overlap` characters, or else at its full size.
    """
    n = len(text)
    places = [[m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)] for mark in BREAKS]

    def end(begin: int) -> int:
        full = begin + size
        if full >= n:
            return n
        for mark, at in zip(BREAKS, places, strict=True):
            k = bisect_right(at, full - len(mark))
            if k and at[k - 1] > begin + size - overlap:
                return at[k - 1] + len(mark)
        return full

    out = [(0, end(0))] if n else []
    while out and out[-1][1] - overlap < n - overlap:
        out.append((out[-1][1] - overlap, end(out[-1][1] - overlap)))
    return out


def chunk_id(document_id: Column, index: Column) -> Column:
    """P5: 16 hexadecimal digits of the hash of 'document:index'."""
    return F.substring(F.sha2(F.concat_ws(":", document_id.cast("string"), index.cast("string")), 256), 1, 16)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, id, text): overlapping windows; blank ones are dropped, not counted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["document_id"], b["text"], strict=True):
                pieces = (text[x:y].strip() for x, y in boundaries(text or "", size, overlap))
                rows += [(doc, i, p) for i, p in enumerate(filter(None, pieces))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text"])

    rows = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text")).where("text is not null")
    out = rows.mapInPandas(run, f"document_id {kind}, chunk_index int, text string")
    return out.select("document_id", "chunk_index", chunk_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "text")


def within_budget(rows: DataFrame, group: str, order: str, text_col: str, limit: int, separator: int = 2) -> DataFrame:
    """The rows of each group, in order, until the joined length has reached the limit."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text_col)).over(before), F.lit(0)) + separator * F.greatest(F.count(F.lit(1)).over(before) - 1, F.lit(0))
    return rows.withColumn("used", used).where(F.col("used") < limit)
