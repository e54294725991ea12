"""Periodic runs of words, found from LZ blocks, and their collapse to one period.

A run is a stretch of words with a smallest period that no neighbouring word extends.  All texts of a batch
are one string whose symbols differ between texts, so that nothing matches across them; the work on it is:

* Suffix array by prefix doubling.  Only suffixes that are still tied are sorted again.  Every level's ranks
  are kept: equal ranks at level k mean equal stretches of 2^k words, so common extensions of any two
  places, to the right and to the left, take one look a level.
* LCP of neighbours in the suffix array; the longest previous factor of each place, by unlinking places from
  the last to the first; blocks that are as long as the longest previous factor (LZ, overlaps allowed).
* Runs that touch a border of blocks, by extensions from the border.  With exponent at least e, a run that
  ends in a block [B, E) after the block [A, B) has e*p/2 words to the right of B, so p <= 2(E-B)/e, or to its
  left; then p <= (E-A)/(e-1), since otherwise the words from A on would also stand one period earlier
  and the block at A would have been longer.  So the pairs of a border and a period are as many as words.
* All other runs lie strictly inside a block and are copies of earlier ones: blocks are walked in order, and
  what starts inside a block's source is copied from the buckets of starts, also to blocks copied later.

Texts are long at most as one row is; memory is about 4 bytes a word and level, and levels end when all
suffixes differ.  No text is cut.

Defined cases: null and empty texts have no words and no runs; repeated and null ids are rows of their own; an empty
table gives no rows; ids of any type are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import sub_batches, text_buffer, tidy, word_bounds

EXPONENT = 4
LEAST = 6
TEXT_BYTES = 1 << 20


# --- extensions ---------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, levels): levels[k][i] is the rank of the 2^k symbols from i on, -1 at the end."""
    n = len(symbols)
    order = np.argsort(symbols)
    slots = np.arange(n)
    sa, rank, tied = order, np.full(n + 1, -1, np.int32), None
    levels, width, keys = [], 1, symbols[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank = rank.copy()
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank)
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied]
        if not len(slots):
            return sa, levels
        order = sa[slots]
        follow = np.minimum(order + width, n)
        keys = rank[order].astype(np.int64) * (n + 2) + rank[follow] + 1
        by = np.argsort(keys)
        order, keys = order[by], keys[by]
        sa[slots] = order
        width *= 2


def right_extension(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree from x and from y on (x and y differ)."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][x + out] == levels[k][y + out]).astype(np.int64) << k
    return out


def left_extension(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree up to x and up to y, backwards (x < y)."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = x - out - (1 << k) + 1
        inside = a >= 0
        a = np.where(inside, a, 0)
        out += (inside & (levels[k][a] == levels[k][np.where(inside, y - out - (1 << k) + 1, 0)])).astype(np.int64) << k
    return out


# --- blocks -------------------------------------------------------------------------------------


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """(longest previous factor of each place, the earlier place it stands at)."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    rank, at, left = rank.tolist(), sa.tolist(), [*lcp.tolist(), 0]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        a, b = left[r], left[q]
        if a >= b:
            if a:
                length[i], source[i] = a, at[p]
            left[q] = b
        else:
            length[i], source[i] = b, at[q]
            left[q] = a
        before[q] = p
        if p >= 0:
            after[p] = q
    return length, source


def blocks(length: list[int]) -> np.ndarray:
    """Starts of the blocks: a new symbol, or the longest previous factor."""
    out, i, n = [], 0, len(length)
    while i < n:
        out.append(i)
        i += length[i] or 1
    return np.array(out, np.int64)


# --- runs ---------------------------------------------------------------------------------------


def _at_borders(symbols, levels, starts, exponent, least):
    """(start, end, period) of the runs that touch a border of blocks."""
    n = len(symbols)
    ends = np.append(starts[1:], n)
    begin = np.append(starts, n)
    here = np.append(ends - starts, 0)
    prev = np.append(0, here[:-1])
    ext = np.append(symbols, -1)
    found = []

    def pairs(most):
        border = np.repeat(begin, most)
        return border, np.arange(1, len(border) + 1) - np.repeat(np.cumsum(most) - most, most)

    def keep(start, end, period):
        ok = end - start >= np.maximum(least, np.ceil(exponent * period))
        found.append(np.stack([start[ok], end[ok], period[ok]], 1))

    border, period = pairs((2 * here / exponent).astype(np.int64))
    far = border + period
    ok = (ext[border] == ext[far]) | ((border > 0) & (ext[border - 1] == ext[far - 1]))
    border, period, far = border[ok], period[ok], far[ok]
    keep(border - left_extension(levels, border - 1, far - 1), far + right_extension(levels, border, far), period)
    border, period = pairs(np.minimum(((prev + here) / (exponent - 1)).astype(np.int64), begin))
    far = border - period
    ok = (ext[border] == ext[far]) | ((far > 0) & (ext[border - 1] == ext[far - 1]))
    border, period, far = border[ok], period[ok], far[ok]
    keep(far - left_extension(levels, far - 1, border - 1), border + right_extension(levels, far, border), period)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of one stretch, its smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def _copied(rows: np.ndarray, starts: np.ndarray, length: list[int], source: list[int], least: int) -> list[tuple[int, int, int]]:
    """All runs: rows, and their copies strictly inside blocks, in the order of starts."""
    buckets: dict[int, list] = {}
    for s, e, p in rows.tolist():
        buckets.setdefault(s, []).append((e, p))
    order = sorted(buckets)
    if order:
        size = np.append(np.diff(starts), len(length) - starts[-1]) if len(starts) else starts
        for b in starts[size > least + 1].tolist():
            if not length[b]:
                continue
            src, shift = source[b], b - source[b]
            stop = src + length[b]
            at = bisect_right(order, src)
            while at < len(order) and order[at] < stop:
                s = order[at]
                for e, p in list(buckets[s]):
                    if e < stop:
                        if s + shift not in buckets:
                            buckets[s + shift] = []
                            insort(order, s + shift)
                        buckets[s + shift].append((e + shift, p))
                at = bisect_left(order, s) + 1
    return [(s, e, p) for s in order for e, p in sorted(buckets[s], key=lambda x: x[1])]


def runs_of(symbols: np.ndarray, exponent: float = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least `exponent` (2 or more) periods and `least` symbols, by start and period."""
    if not len(symbols):
        return []
    sa, levels = suffix_array(symbols)
    lcp = np.zeros(len(sa), np.int64)
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[same] = right_extension(levels, sa[same - 1], sa[same])
    length, source = previous_factors(sa, lcp)
    starts = blocks(length)
    return _copied(_at_borders(symbols, levels, starts, exponent, least), starts, length, source, least)


def batch_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, each row's first word with the total last): words of different rows are different symbols."""
    starts, ends, first = word_bounds(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), first
    cuts = np.append(np.stack([starts, ends], 1).reshape(-1), len(data))
    if cuts[0]:
        cuts = np.concatenate([[0], cuts])
        skip = 1
    else:
        skip = 0
    column = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.take(pa.array(np.arange(skip, len(cuts) - 1, 2))).dictionary_encode()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row * len(coded.dictionary) + coded.indices.to_numpy(), first


FACTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]):
    """(the facts of one text, its kept words joined)."""
    if not runs:
        text = b" ".join(words)
        return (0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(text).hexdigest()), text
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    best = runs[0]
    for x in runs[1:]:  # the greatest length / period as a fraction; earlier ones win ties
        if (x[1] - x[0]) * best[2] > (best[1] - best[0]) * x[2]:
            best = x
    drop = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        drop[s + p] += 1
        drop[e] -= 1
    text = b" ".join([w for w, x in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not x])
    s, e, p = best
    return (len(runs), s, e - s, p, 1000 * (e - s) // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()), text


def collapse(docs: DataFrame, id_col="doc_id", text_col="text", exponent: float = EXPONENT, least: int = LEAST, with_runs: bool = False) -> DataFrame:
    """doc_id and FACTS of each text: its runs, the one with the greatest exponent, digests of the runs and of the text
    without what follows each run's first period; with_runs: also `runs` (start, length, period) and `text`."""

    def run(batches):
        for b in sub_batches(batches, limit=TEXT_BYTES):
            column = b.column(1)
            symbols, first = batch_symbols(*text_buffer(column))
            all_runs = runs_of(symbols, exponent, least)
            at = np.searchsorted(np.array([s for s, _, _ in all_runs], np.int64), first).tolist()
            first = first.tolist()
            facts, texts, held = [], [], []
            for i in range(b.num_rows):
                words = column[i].as_buffer().to_pybytes().split() if column[i].is_valid else []
                own = [(s - first[i], e - first[i], p) for s, e, p in all_runs[at[i] : at[i + 1]]]
                row, text = _summary(words, own)
                facts.append(row)
                if with_runs:
                    texts.append(text.decode("utf-8", "replace"))
                    held.append([{"start": s, "length": e - s, "period": p} for s, e, p in own])
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(x, k) for x, k in zip(zip(*facts, strict=True), kinds, strict=True)]
            more = [pa.array(held, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(texts, pa.string())] if with_runs else []
            names = [x.split()[0] for x in FACTS.split(", ")] + ["runs", "text"] * with_runs
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *more], names=["doc_id", *names])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", runs array<struct<start: long, length: long, period: long>>, text string" * with_runs
    return picked.mapInArrow(run, f"doc_id {kind}, {FACTS}{more}")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's periodic tails: of ids whose crc32 ends in 0, the words from a on repeat p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("g", g)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: runs of at least four periods and six words, in documents with planted tails."""
    return collapse(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
