"""Substring dedup by level-wise doubling of repeated word windows.

Level 0 takes all windows of `width` words.  A window is repeated if its words also stand in another
document.  Only windows repeated at one length go on: where the windows at i and i + length of a
document are both repeated, the one of twice the length at i is a candidate of the next level, named
by its halves' names.  Levels end when no candidate is repeated.

One level: every task hashes the windows of its documents and keeps, of each hash, only the entries of
the smallest document in the task's block; for the others a smaller document is already known.  The
entries of a block go, packed by byte planes, to the task that owns their hash range, which finds the
smallest document of each hash over all blocks.  So a window that stands in a third of all documents
costs one entry for each block.  Names carry 56 bits beside their range; false matches are as rare as
one in 10^10 windows of a task.

The words to remove follow from level 0 alone: all words of windows for which a smaller document is
known.  The higher levels give `longest`, a lower bound by doubling of the longest shared passage.

Defined cases: null and empty texts have no words; rows that repeat a doc_id are taken as documents in
a fixed order of their texts, null ids after all others; ids may be of any type that sorts; windows never span documents; very long texts are used whole; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import MULTS, U64, binary_rows, drop_folder, identified, mix, release, sub_batches, text_buffer, tidy, windows, word_bounds, word_hashes, written

WIDTH = 13
BLOCK_BYTES = 4 << 20
PACKED = "key long, local boolean, n long, rids binary, counts binary, places binary, names binary, known binary"
FOUND = "bucket int, rids binary, counts binary, places binary, names binary, later binary"


def _runs(values: np.ndarray):
    """(begin, end) of each run of equal values; none without values."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(cuts, np.append(cuts, len(values))[1:], strict=True)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of each value, first all first bytes, then all second ones, and so on."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def _pack_docs(rid: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Entries sorted by (rid, pos) as differences of rids, counts, differences of places."""
    at = np.flatnonzero(np.diff(rid, prepend=rid[0] - 1)) if len(rid) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(rid)))
    step = np.diff(pos, prepend=0)
    step[at] = pos[at]
    return _planes(np.diff(rid[at], prepend=0).astype("<i8")), _planes(counts.astype("<u4")), _planes(step.astype("<u4")), len(at)


def _unpack_docs(rids: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = _unplanes(counts, "<u4", len(counts) // 4).astype(np.int64)
    rid = np.repeat(np.cumsum(_unplanes(rids, "<i8", len(count))), count)
    step = _unplanes(places, "<u4", len(places) // 4).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    return rid, total - np.repeat(total[first] - step[first], count)


def _packed(h: np.ndarray, rid: np.ndarray, pos: np.ndarray, ranges: int):
    """A batch of PACKED rows from one block's windows, given in the order of (rid, pos)."""
    out = []

    def row(key, local, s, known):
        rids, counts, places, _ = _pack_docs(rid[s], pos[s])
        names = np.ascontiguousarray((h[s] if local else h[s] >> U64(8)).astype("<u8")).view(np.uint8).reshape(-1, 8)
        out.append((key, local, len(s), rids, counts, places, names[:, : 8 if local else 7].T.tobytes(), np.packbits(known).tobytes()))

    if len(h):
        order = np.argsort(h)
        hs, rs = h[order], rid[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        at = np.flatnonzero(new)
        flag = np.zeros(len(h), bool)
        size = np.diff(np.append(at, len(hs)))
        many = np.flatnonzero(size > 1)  # hashes that occur more than once in the block
        rest = np.zeros(0, np.int64)
        if len(many):
            s = order[np.repeat(size > 1, size)]
            bounds = np.cumsum(size[many]) - size[many]
            later = rid[s] > np.repeat(np.minimum.reduceat(rid[s], bounds), size[many])
            flag[s] = np.repeat(np.logical_or.reduceat(later, bounds), size[many])
            rest = np.sort(s[later])
        keep = np.ones(len(h), bool)
        keep[rest] = False
        mine = np.flatnonzero(keep)  # in the order of (rid, pos), as h is
        q = ((h[mine] & U64(0xFF)) << U64(24)) | ((h[mine] >> U64(8)) & U64(0xFFFFFF))
        owner = (q * U64(ranges)) >> U64(32)
        by = np.argsort(owner.astype(np.uint16), kind="stable") if ranges <= 1 << 16 else np.argsort(owner, kind="stable")
        mine, owner = mine[by], owner[by].astype(np.int64)
        for a, b in _runs(owner):
            s = mine[a:b]
            row(int(owner[a]), False, s, flag[s])
        if len(rest):
            row(ranges + int(rid[rest[0]] % ranges), True, rest, np.ones(len(rest), bool))
    columns = list(zip(*out, strict=True)) or [[]] * 8
    kinds = (pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "local", "n", "rids", "counts", "places", "names", "known"])


def _resolve(buckets: int, ranges: int):
    """Of one range's entries from all blocks, those that are repeated, by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        rid, pos, name, later = [], [], [], []
        parts = [(_unpack_docs(r["rids"], r["counts"], r["places"]), r) for r in table.to_pylist()]
        owned = [(d, r) for d, r in parts if not r["local"]]
        if owned:
            d = np.concatenate([x[0][0] for x in owned])
            p = np.concatenate([x[0][1] for x in owned])
            h = np.zeros((len(d), 8), np.uint8)
            h[:, 1:] = np.concatenate([np.frombuffer(r["names"], np.uint8).reshape(7, r["n"]).T for _, r in owned])
            h = h.view("<u8").reshape(-1)
            known = np.concatenate([np.unpackbits(np.frombuffer(r["known"], np.uint8), count=r["n"]).astype(bool) for _, r in owned])
            order = np.argsort(h)
            hs, ds = h[order], d[order]
            at = np.flatnonzero(np.diff(hs, prepend=hs[0] - U64(1)) != 0)
            size = np.diff(np.append(at, len(hs)))
            least = np.repeat(np.minimum.reduceat(ds, at), size)
            other = ds > least
            repeated = np.repeat(np.logical_or.reduceat(other | known[order], at), size)
            s = order[repeated]
            rid.append(d[s])
            pos.append(p[s])
            # the range is part of the name, so that names of different ranges differ
            name.append(mix(h[s] ^ (np.array([owned[0][1]["key"]], np.uint64) * MULTS[11])))
            later.append(other[repeated])
        for (d, p), r in parts:
            if r["local"]:
                h = np.frombuffer(r["names"], np.uint8).reshape(8, r["n"]).T
                h = np.ascontiguousarray(h).view("<u8").reshape(-1)
                q = ((h & U64(0xFF)) << U64(24)) | ((h >> U64(8)) & U64(0xFFFFFF))
                owner = (q * U64(ranges)) >> U64(32)
                rid.append(d)
                pos.append(p)
                name.append(mix((h >> U64(8) << U64(8)) ^ (owner * MULTS[11])))
                later.append(np.ones(len(d), bool))
        rid, pos, name, later = (np.concatenate(x) for x in (rid, pos, name, later))
        bucket = (mix(rid.astype(np.uint64)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((pos, rid, bucket))
        rid, pos, name, later, bucket = rid[order], pos[order], name[order], later[order], bucket[order]
        out = []
        for a, b in _runs(bucket):
            rids, counts, places, _ = _pack_docs(rid[a:b], pos[a:b])
            out.append((int(bucket[a]), rids, counts, places, name[a:b].tobytes(), np.packbits(later[a:b]).tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int32(), *[pa.binary()] * 5)
        tidy()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "rids", "counts", "places", "names", "later"])

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """Of one bucket of documents, a row for each: its repeated windows in order."""
    rid, pos, name, later = [], [], [], []
    for r in table.to_pylist():
        d, p = _unpack_docs(r["rids"], r["counts"], r["places"])
        rid.append(d)
        pos.append(p)
        name.append(np.frombuffer(r["names"], "<u8"))
        later.append(np.unpackbits(np.frombuffer(r["later"], np.uint8), count=len(d)).astype(np.uint8))
    rid, pos, name, later = (np.concatenate(x) for x in (rid, pos, name, later))
    order = np.lexsort((pos, rid))
    rid, pos, name, later = rid[order], pos[order], name[order], later[order]
    at = np.flatnonzero(np.diff(rid, prepend=rid[0] - 1))
    bounds = np.append(at, len(rid))
    tidy()
    return pa.table([pa.array(rid[at]), binary_rows(pos.astype("<u4"), bounds), binary_rows(name, bounds), binary_rows(later, bounds)], names=["rid", "places", "names", "later"])


REPEATED = "rid long, places binary, names binary, later binary"


def _level(packed: DataFrame, ranges: int, buckets: int, large: bool = False) -> tuple[DataFrame, str]:
    """One level's repeated windows, a row for each document that has any; large: drop shuffle files at once."""
    found, path = written(packed.repartition(ranges, "key").groupBy("key").applyInArrow(_resolve(buckets, ranges), FOUND), "found")
    if large:
        release(packed.sparkSession)
    rows = written(found.groupBy("bucket").applyInArrow(_assemble, REPEATED), "repeated")
    drop_folder(packed.sparkSession, path.rsplit("/", 1)[0])
    return rows


def find_repeats(rows: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """rows (rid, text) -> (level 0's repeated windows per document, (rid, longest))."""
    spark = rows.sparkSession
    ranges = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def first(batches):
        for b in sub_batches(batches, limit=BLOCK_BYTES):
            rid = b.column(0).to_numpy()
            if (np.diff(rid) < 0).any():
                b = b.take(pa.array(np.argsort(rid)))
                rid = b.column(0).to_numpy()
            data, offs = text_buffer(b.column(1))
            starts, ends, at = word_bounds(data, offs)
            h, row, pos = windows(word_hashes(data, starts, ends, lower=False), at, width)
            yield _packed(h, rid[row], pos, ranges)
        tidy()

    def doubled(length: int):
        def run(batches):
            for b in batches:
                held = ([], [], [])
                weight = count = 0
                for i in np.argsort(b.column(0).to_numpy()).tolist():
                    pos = np.frombuffer(b.column(1)[i].as_buffer(), "<u4").astype(np.int64)
                    name = np.frombuffer(b.column(2)[i].as_buffer(), "<u8")
                    at = np.searchsorted(pos, pos + length)
                    ok = at < len(pos)
                    ok[ok] = pos[at[ok]] == pos[ok] + length
                    held[0].append(mix(name[ok] * MULTS[12] + name[at[ok]] * MULTS[13]))
                    held[1].append(np.full(int(ok.sum()), b.column(0)[i].as_py()))
                    held[2].append(pos[ok])
                    weight += len(held[2][-1])
                    count += 1
                    if weight >= BLOCK_BYTES // 6 or count == b.num_rows:
                        yield _packed(*(np.concatenate(x) for x in held), ranges)
                        held, weight = ([], [], []), 0
            tidy()

        return run

    level, _ = _level(rows.select("rid", "text").mapInArrow(first, PACKED), ranges, ranges, large=True)
    release(spark)
    ranges = max(8, ranges // 4)  # what is left is a small part of the windows
    base, length, longest = level, width, level.select("rid", F.lit(width).alias("length"))
    while True:
        level, path = _level(level.select("rid", "places", "names").mapInArrow(doubled(length), PACKED), ranges, ranges)
        length *= 2
        if level.isEmpty():
            break
        longest = longest.unionByName(level.select("rid", F.lit(length).alias("length")))
    return base, longest.groupBy("rid").agg(F.max("length").alias("longest"))


def removed_spans(base: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, spans): int32 pairs of first word and end of each run of words to remove."""

    def run(batches):
        for b in batches:
            spans = []
            for p, later in zip(b.column(1), b.column(2), strict=True):
                at = np.frombuffer(p.as_buffer(), "<u4").astype(np.int64)[np.frombuffer(later.as_buffer(), np.uint8) > 0]
                cut = np.flatnonzero(np.diff(at) > width)
                spans.append(np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + width], 1).astype("<i4").tobytes() if len(at) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.binary())], names=["rid", "spans"])

    return base.select("rid", "places", "later").mapInArrow(run, "rid long, spans binary")


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest (and kept_text) of every document."""
    rows = identified(docs, id_col, text_col)
    base, longest = find_repeats(rows, width)
    facts = removed_spans(base, width).join(longest, "rid", "left")
    facts, _ = written(facts, "spans")

    def run(batches):
        for b in batches:
            n, gone, digest, kept_text = [], [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                keep = np.ones(len(words), bool)
                if s.is_valid:
                    for x, y in np.frombuffer(s.as_buffer(), "<i4").reshape(-1, 2):
                        keep[x:y] = False
                text = b" ".join(words if keep.all() else compress(words, keep))
                n.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept_text.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), b.column(3), *([pa.array(kept_text, pa.string())] if with_text else [])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "longest", *(["kept_text"] if with_text else [])],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(facts, "rid", "left").select("doc_id", "text", "spans", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, longest long" + ", kept_text string" * with_text)


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed as repeats of an earlier document's passage."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, w FROM dw WHERE len(w) >= 13),
b AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 12], ' ')) AS name FROM x),
l0 AS (SELECT doc_id, k, name, min(doc_id) OVER (PARTITION BY name) AS lo, max(doc_id) OVER (PARTITION BY name) AS hi FROM b),
lv AS (SELECT 13 AS length, doc_id, k, name FROM l0 WHERE lo < hi
 UNION ALL SELECT length, doc_id, k, name FROM (SELECT *, min(doc_id) OVER (PARTITION BY name) AS lo, max(doc_id) OVER (PARTITION BY name) AS hi
  FROM (SELECT 2 * p.length AS length, p.doc_id, p.k, md5(p.name || q.name) AS name FROM lv p JOIN lv q ON p.doc_id = q.doc_id AND q.k = p.k + p.length)) WHERE lo < hi),
g AS (SELECT DISTINCT doc_id, k + unnest(range(0, 13)) AS k FROM l0 WHERE lo < doc_id),
f AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM dw),
t AS (SELECT f.doc_id, count(*) AS n, count(g.k) AS gone, string_agg(word, ' ' ORDER BY f.k) FILTER (g.k IS NULL) AS kept FROM f LEFT JOIN g ON g.doc_id = f.doc_id AND g.k = f.k GROUP BY f.doc_id),
m AS (SELECT doc_id, max(length) AS longest FROM lv GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.gone, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256, CAST(coalesce(m.longest, 0) AS BIGINT) AS longest FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
