"""Secret scans: fixed patterns plus a randomness test battery with false-discovery control.

Patterns (assign, access, hex) are matched leftmost and non-overlapping in the whole text.  Beside
them, every run of letters, digits and the signs of encodings of at least `least` characters that mixes
letters and digits is a candidate.  Its encoding is inferred (hex, base32, base62, base64) and three tests
ask how well its characters fit uniform and independent draws: chi-squared uniformity over the alphabet, the
runs test about the middle of the alphabet, and lag-one serial correlation.  The method of Fisher joins
the three into one score, which is high for random strings and near zero for language.

The hypothesis to reject is that a candidate is ordinary writing.  Its law is measured: from every document,
windows of its ordinary words, put together without spaces and again, with its short numbers, by signs as
identifiers and paths are, are taken at a fixed distance and go through the same battery, for each length
class by itself, as short strings tell language and chance apart less well.  A
candidate has as its p-value the share of windows of its class that look at least as random.  The step of
Benjamini and Hochberg over all candidates of the corpus then bounds the share of false discoveries
among the reported strings by `q`; those are reported as kind random.  A fixed text is part of the windows, so
that a corpus of few words has a law too.

The step needs only counts for each length class and score bin: a fixed number of cells whatever the input.

Defined cases: null and empty texts have no spans; ties in start go by kind (assign, access, hex,
random); repeated rows are scanned as rows of their own; an empty table gives no rows; extra columns are not
read; a candidate that overlaps the span of a pattern is not reported again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import sub_batches, text_buffer, word_bounds, written

KINDS = ("assign", "access", "hex", "random")
# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
Q = 0.05
BINS_PER_OCTAVE = 8
MOST_BIN = 1074 * BINS_PER_OCTAVE
CLASS_EDGES = (32, 64, 128)
WINDOWS = (LEAST, *CLASS_EDGES)  # lengths of a class's ordinary windows: its shortest strings
WINDOW_GAP, OWN_GAP = 512, 3
SHORT_NUMBER = 6
# Some ordinary writing, part of the law beside the corpus itself.
PROSE = """Secret scans: fixed patterns plus a randomness test battery with false-discovery control.

Patterns (assign, access, hex) are matched leftmost and non-overlapping in the whole text.  Beside
them, every run of letters, digits and the signs of encodings of at least `least` characters that mixes
letters and digits is a candidate.  Its encoding is inferred (hex, base32, base62, base64) and three tests
ask how well its characters fit uniform and independent draws: chi-squared uniformity over the alphabet, the
runs test about the middle of the alphabet, and lag-one serial correlation.  The method of Fisher joins
the three into one score, which is high for random strings and near zero for language.

The hypothesis to reject is that a candidate is ordinary writing.  Its law is measured: from every document,
windows of its ordinary words, put together without spaces and again, with its short numbers, by signs as
identifiers and paths are, are taken at a fixed distance and go through the same battery, for each length
class by itself, as short strings tell language and chance apart less well.  A
candidate has as its p-value the share of windows of its class that look at least as random.  The step of
Benjamini and Hochberg over all candidates of the corpus then bounds the share of false discoveries
among the reported strings by `q`; those are reported as kind random.  This text is part of the windows, so
that a corpus of few words has a law too.

The step needs only counts for each length class and score bin: a fixed number of cells whatever the input.

Defined cases: null and empty texts have no spans; ties in start go by kind (assign, access, hex,
random); repeated rows are scanned as rows of their own; an empty table gives no rows; extra columns are not
read; a candidate that overlaps the span of a pattern is not reported again.
"""
# Alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RUN = _flags(LETTERS + "0123456789+/_.=-")
SEPARATOR = _flags(":=")
DIGIT, UPPER = _flags("0123456789"), _flags(LETTERS[:26])
BETWEEN_WORDS = ~_flags(LETTERS + "0123456789")


# A byte's code in each alphabet, - and _ as in the URL form of base64.
CODES = {name: np.array([text.find({"-": "+", "_": "/"}.get(chr(c), chr(c)) if name == "base64" else chr(c)) for c in range(256)]) for name, text in ALPHABETS.items()}


def infer_encoding(s: str) -> tuple[str, list[int]]:
    """The narrowest alphabet that holds the string, and its codes there."""
    body = s.rstrip("=")
    for name, text in (("hex", body.lower() if body == body.upper() or body == body.lower() else body), ("base32", body), ("base62", body), ("base64", body.replace("-", "+").replace("_", "/"))):
        codes = [ALPHABETS[name].find(c) for c in text]
        if min(codes, default=-1) >= 0:
            return name, codes
    return "base64", [c for c in codes if c >= 0]


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in np.asarray(x, float).tolist()])


def chi2_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-squared by Wilson and Hilferty."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * _erfc(z / math.sqrt(2))


def batteries(x: np.ndarray, k: int) -> np.ndarray:
    """The score of each row of codes below k: the joint p-value of the three tests."""
    m, n = x.shape
    if not m:
        return np.zeros(0)
    bins = max(2, min(k, n // 5))
    seen = np.bincount((x * bins // k + np.arange(m)[:, None] * bins).reshape(-1), minlength=m * bins).reshape(m, bins)
    share = np.bincount(np.arange(k) * bins // k, minlength=bins) / k
    p1 = chi2_tail((((seen - n * share) ** 2) / (n * share)).sum(1), bins - 1)
    high = x >= k // 2
    a = high.sum(1)
    b = n - a
    mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    z = (1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / np.sqrt(np.maximum(var, 1e-9))
    p2 = np.where((a > 0) & (b > 0), _erfc(np.abs(z) / math.sqrt(2)), 2.0 ** (1 - n))
    c = x - x.mean(1, keepdims=True)
    r = (c[:, 1:] * c[:, :-1]).sum(1) / np.maximum(1e-9, (c * c).sum(1))
    p3 = _erfc(np.abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    stat = -sum(np.log(np.maximum(p, 1e-300)) for p in (p1, p2, p3))
    return np.exp(-stat) * (1 + stat + stat * stat / 2)  # chi-squared with 6 degrees, closed form


def battery(s: str) -> float:
    """The score of one string; 0 for strings that have no codes to test."""
    name, codes = infer_encoding(s)
    return float(batteries(np.array([codes]), len(ALPHABETS[name]))[0]) if len(codes) >= 8 else 0.0


def _joined(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, sign: bool):
    """(bytes, row bounds) of the given words put together; with `sign`, _ and - in turn follow them."""
    edge = np.zeros(len(data) + 2, np.int64)
    row_end = offs[1:][np.searchsorted(offs[1:], starts, side="right")] if len(starts) else ends
    stop = np.minimum(ends + 1, row_end) if sign else ends
    edge[starts] += 1
    np.subtract.at(edge, stop, 1)
    held = np.cumsum(edge)[: len(data)] > 0
    raw = data.copy() if sign else data
    if sign:
        gaps = stop[stop > ends] - 1
        first = np.searchsorted(gaps, offs)  # signs take turns inside a row
        turn = np.arange(len(gaps)) - first[np.searchsorted(offs, gaps, side="right") - 1]
        raw[gaps] = np.where(turn % 2, ord("-"), ord("_"))
    return raw[held], np.concatenate([[0], np.cumsum(held)])[offs]


def ordinary_cells(data: np.ndarray, offs: np.ndarray, least: int = LEAST, gap: int = WINDOW_GAP) -> dict[tuple[int, int], int]:
    """Windows per (length class, bin) of the rows' ordinary words: letters alone, or short numbers."""
    starts, ends, _ = word_bounds(data, offs, BETWEEN_WORDS)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    share = digits[ends] - digits[starts]
    plain = (share == 0) & (ends - starts < least)
    number = (share == ends - starts) & (share <= SHORT_NUMBER)
    out: dict[tuple[int, int], int] = {}
    for sign, some in ((False, plain), (True, plain | number)):
        letters, bounds = _joined(data, offs, starts[some], ends[some], sign)
        for cls, length in enumerate(WINDOWS):
            count = np.maximum(0, (np.diff(bounds) - length) // gap + 1)
            at = np.repeat(bounds[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * gap
            for i in range(0, len(at), 4096):
                text = letters[at[i : i + 4096, None] + np.arange(length)]
                upper = UPPER[text].all(1)
                for rows, name in ((text[~upper], "base64" if sign else "base62"), (text[upper], "base32")):
                    found, n = np.unique(p_bins(batteries(CODES[name][rows], len(ALPHABETS[name]))), return_counts=True)
                    for x, y in zip(found.tolist(), n.tolist(), strict=True):
                        out[cls, x] = out.get((cls, x), 0) + y
    return out


def p_bins(p: np.ndarray) -> np.ndarray:
    """0 for p = 1, larger for smaller p."""
    return np.minimum(MOST_BIN, (-np.log2(np.maximum(p, 2.0**-1074)) * BINS_PER_OCTAVE).astype(np.int64)) if len(p) else np.zeros(0, np.int64)


def length_class(n: int) -> int:
    return sum(n >= e for e in CLASS_EDGES)


def scan_text(text: str, least: int = LEAST):
    """(base spans, candidates): (start, kind index, end) and (start, end, class, bin)."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    base.sort()
    found, i, reach = [], 0, -1
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text):
        s = m[0]
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach > m.start() or not re.search(r"[0-9]", s) or not re.search(r"[A-Za-z]", s):
            continue
        found.append((m.start(), m.end(), length_class(len(s)), int(p_bins(np.array([battery(s)]))[0])))
    return base, found


def reported_bins(counts: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], q: float = Q) -> list[int]:
    """Per length class, the last bin that is reported (-1: none); both tables hold numbers per (class, bin).

    A candidate's p-value is the share of its class's ordinary windows, itself counted among them, that look at
    least as random.
    """
    cells = []
    for cls in range(len(WINDOWS)):
        law = sorted((b, n) for (c, b), n in ordinary.items() if c == cls)
        bins, total = [b for b, _ in law], np.cumsum([0, *(n for _, n in law)])
        cells += [((1 + int(total[bisect_right(bins, b)])) / (1 + int(total[-1])), cls, b, n) for (c, b), n in counts.items() if c == cls]
    m, limit, seen = sum(counts.values()), -1.0, 0
    for value, _, _, n in sorted(cells):
        seen += n
        if value <= q * seen / m:
            limit = value
    return [max((b for value, c, b, _ in cells if c == cls and value <= limit), default=-1) for cls in range(len(WINDOWS))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, q: float = Q) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), code points, end exclusive."""

    def find(batches):
        for b in sub_batches(batches):
            data, offs = text_buffer(b.column(1))
            n = len(data)
            run = np.zeros(n + 2, np.int8)
            run[1:-1] = RUN[data]
            d = np.diff(run)
            starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
            cuts = np.unique(offs[1:-1])  # a run ends with its row
            cuts = cuts[(run[cuts] & run[cuts + 1]).astype(bool)]
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            hit = np.zeros(len(offs) - 1, bool)
            for at in (starts[ends - starts >= min(16, least)], np.flatnonzero(SEPARATOR[data])):
                hit[np.searchsorted(offs, at, side="right") - 1] = True
            bases, found = [()] * len(hit), [()] * len(hit)
            for i in np.flatnonzero(hit):
                bases[i], found[i] = scan_text(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"), least)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            cells = ordinary_cells(data, offs, least)
            law = [[{"cls": c, "bin": x, "n": n} for (c, x), n in cells.items()]] + [[]] * (len(hit) - 1)
            extra = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cls", pa.int32()), ("bin", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in r] for r in bases], kind), pa.array([[dict(zip(("start", "end", "cls", "bin"), x, strict=True)) for x in r] for r in found], extra), pa.array(law, pa.list_(pa.struct([("cls", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])))],
                names=["doc_id", "base", "found", "ordinary"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = picked.mapInArrow(find, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,cls:int,bin:int>>, ordinary array<struct<cls:int,bin:int,n:bigint>>")
    rows, _ = written(rows, "secrets")
    cells = {(r["cls"], r["bin"]): r["count"] for r in rows.select(F.explode("found").alias("x")).groupBy("x.cls", "x.bin").count().collect()}
    law = {(r["cls"], r["bin"]): r["n"] for r in rows.select(F.explode("ordinary").alias("x")).groupBy("x.cls", "x.bin").agg(F.sum("x.n").alias("n")).collect()}
    for cell, n in ordinary_cells(*text_buffer(pa.array([PROSE])), gap=OWN_GAP).items():
        law[cell] = law.get(cell, 0) + n
    limits = reported_bins(cells, law, q)
    keep = f"transform(filter(found, x -> x.bin <= element_at(array({', '.join(map(str, limits))}), x.cls + 1)), x -> named_struct('start', x.start, 'kind', 3, 'end', x.end))"
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.expr(keep))).alias("spans"))


def _digest(column: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.array_join(F.expr(f"transform({column}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end))"), ",")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: pattern counts, the digest of their spans, and all spans of each document."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as bigint)")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"), count(3).alias("n_random"))
