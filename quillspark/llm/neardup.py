"""MinHash near-duplicate classes with sequential Bayesian verification.

1. One pass over the texts gives each document's shingle count, a 128-bit hash of its shingle set (64 bits
   from each of two independent word hashes), the keys of its 32 MinHash bands, and a one-permutation
   sketch of 256 bins for comparing.  Documents with one shingle set form a class, carried by its first row.
2. In each band's bucket every class is paired with the bucket's first class, and likewise in the finer
   bucket of this and the next band; a bucket of n gives fewer than 2 n pairs.
3. Pairs are compared in batches of bins.  After each batch the posterior of the similarity (uniform
   prior, binomial matches) is asked for P(similarity >= threshold); below `miss` the pair is dropped.
4. Survivors are verified on the words of their whole texts, and links joined to components.
5. Buckets that still hold more than one component are refined: their members outside the largest
   component are first paired among themselves as in step 2 and with the members of it that have most
   links.  What then still stands outside is compared with all members of other components, by pairs in
   small buckets, block against block in large ones (a block is bounded in members and in shingles).
   Sizes, shingles that no other open document has, and sketches rule most out; the rest is verified as in
   step 4.  A bucket with very many outside is first banded again by its members' sketches.

Chances to miss a link of similarity 0.75: banding less than 6e-6, banding again likewise (64 bands of 6),
the sequential test `miss` a pair, the sketch bits of a small bucket four standard deviations (3e-5).

Keys that hold more than a twenty-thousandth of a table's rows (so fewer than 20,000 keys) are joined by
broadcast, the others by shuffle, so that no task gets a hot bucket.

Defined cases: null and empty texts have no shingles and link with nothing; texts of fewer words than
a shingle have all their words as one; rows that repeat a doc_id are rows of their own, with a
component's smallest doc_id as its id; a null doc_id comes after all others; ids may be of any type that sorts;
very long texts are used whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import MULTS, U64, binary_rows, identified, mix, release, shingle_sets, sub_batches, text_buffer, tidy, word_bounds, word_hashes, written

WIDTH = 5
PERCENT = 75
HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
BINS = 256
SUB_BANDS, SUB_ROWS = 64, 6
FEW_OUTSIDE = 1024
SMALL_BUCKET = 32
BLOCK_MEMBERS, BLOCK_OUTSIDE, BLOCK_SHINGLES = 1024, 256, 1 << 20
BATCH_BINS = 32
BATCH_BYTES = 1 << 20
FILTER_BITS = 1 << 27
MISS = 1e-6
HEAVY_KEYS = 20_000
_seeds = np.random.default_rng(424242)
PERM_A = _seeds.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
PERM_B = _seeds.integers(0, 2**63, HASHES, dtype=np.uint64)


def signatures(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, [row, hash]): the MinHash values of each row's sorted run of shingle hashes."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.empty((len(at), HASHES), np.uint32)
    if len(at):
        v = np.empty_like(h)
        for i in range(HASHES):
            np.multiply(h, PERM_A[i], out=v)
            v += PERM_B[i]
            v >>= U64(32)
            out[:, i] = np.minimum.reduceat(v.astype(np.uint32), at)
    return row[at], out


def bins(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """[row, bin] one-permutation sketch: 16 bits of each bin's smallest hash, 0 where it is empty."""
    h = mix(h ^ MULTS[9])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    cell = row * BINS + (h >> U64(56)).astype(np.int64)
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(rows * BINS, np.uint16)
    out[cell[at]] = (h[at] & U64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out.reshape(rows, BINS)


def sketch(rows: DataFrame) -> DataFrame:
    """rid, n_shingles, k1, k2 (hashes of the set), bands (keys), sig (bins); null without shingles."""

    def run(batches):
        for b in sub_batches(batches, limit=BATCH_BYTES):
            data, offs = text_buffer(b.column(1))
            starts, ends, first = word_bounds(data, offs)
            h, row, other = shingle_sets(word_hashes(data, starts, ends, lower=True), first, WIDTH, word_hashes(data, starts, ends, lower=True, lane=1))
            n = np.bincount(row, minlength=b.num_rows)
            k = np.zeros((2, b.num_rows), np.uint64)
            rows, values = signatures(h, row)
            if len(rows):
                at = np.flatnonzero(np.diff(row, prepend=-1))
                k[0, rows] = np.add.reduceat(mix(h ^ MULTS[7]), at)
                k[1, rows] = np.add.reduceat(mix(other ^ MULTS[8]), at)
            keys = mix((values.astype(np.uint64).reshape(-1, BANDS, ROWS) * MULTS[21 : 21 + ROWS]).sum(2) + np.arange(BANDS, dtype=np.uint64) * MULTS[20])
            held = np.concatenate([[0], np.cumsum(n > 0)])
            sig = bins(h, row, b.num_rows)[n > 0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)), binary_rows(keys.reshape(-1), held * BANDS), binary_rows(sig.reshape(-1), held * BINS)],
                names=["rid", "n_shingles", "k1", "k2", "bands", "sig"],
            )
        tidy()

    return rows.select("rid", "text").mapInArrow(run, "rid long, n_shingles long, k1 long, k2 long, bands binary, sig binary")


def _matrix(column, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def bands(classes: DataFrame) -> DataFrame:
    """(key, fine, cid): a row for each class and band; fine joins the band with the next one."""

    def run(batches):
        for b in batches:
            keys = _matrix(b.column(1), "<u8", BANDS)
            fine = mix(keys * MULTS[24] + np.roll(keys, -1, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(fine.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "fine", "cid"])
        tidy()

    return classes.select("cid", "bands").mapInArrow(run, "key long, fine long, cid long")


def sub_bands(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, fine, cid) of a bucket's members, banded again by bins that the bucket's key picks."""
    places = np.arange(SUB_BANDS * SUB_ROWS, dtype=np.uint64) * MULTS[22]

    def run(batches):
        for b in batches:
            key, sig = b.column(0).to_numpy().view(np.uint64), _matrix(b.column(2), "<u2", BINS)
            rows = (mix(key[:, None] + places) % U64(BINS)).astype(np.int64)
            values = np.take_along_axis(sig, rows, 1).astype(np.uint64).reshape(-1, SUB_BANDS, SUB_ROWS)
            keys = mix((values * MULTS[25 : 25 + SUB_ROWS]).sum(2) + key[:, None] + np.arange(1, SUB_BANDS + 1, dtype=np.uint64) * MULTS[20])
            keys = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, keys, pa.array(np.repeat(b.column(1).to_numpy(), SUB_BANDS))], names=["key", "fine", "cid"])
        tidy()

    return members.join(classes, "cid").select("key", "cid", "sig").mapInArrow(run, "key long, fine long, cid long")


def least_matches(miss: float = MISS, percent: int = PERCENT) -> np.ndarray:
    """[n]: the fewest matches in n filled bins with P(similarity >= threshold | matches) >= miss."""
    x = (np.arange(20000) + 0.5) / 20000
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        m = int(out[n - 1])
        while True:
            logp = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logp - logp.max())
            if p[x >= percent / 100].sum() >= miss * p.sum():
                break
            m += 1
        out[n] = m
    return out


def prune(pairs: DataFrame, classes: DataFrame, miss: float, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the sequential test do not rule out."""
    need = least_matches(miss, percent)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                x, y = _matrix(s.column(2), "<u2", BINS), _matrix(s.column(3), "<u2", BINS)
                live = np.arange(len(x))
                filled, seen = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                for to in range(BATCH_BINS, BINS + 1, BATCH_BINS):
                    p, q = x[live, to - BATCH_BINS : to], y[live, to - BATCH_BINS : to]
                    some = (p | q) > 0
                    filled[live] += some.sum(1)
                    seen[live] += (some & (p == q)).sum(1)
                    live = live[seen[live] >= need[filled[live]]]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(live)), s.column(1).take(pa.array(live))], names=["a", "b"])
        tidy()

    of = lambda s: classes.select(F.col("cid").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of a hash of each id (cid), as 64-bit words: 16 bits an id, at most FILTER_BITS in all."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("cid"), F.lit(bits))
    cells = ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("w").to_numpy()] = cells.column("b").to_numpy()
    return out.view(np.uint64)


def texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, text) of the rows in ids (cid), and of a few others.

    A filter of bounded size goes to the scan of the texts, so that texts are not shuffled; the others are
    its false hits, which later joins leave out.
    """
    have = id_filter(ids)

    def run(batches):
        for whole in batches:
            at = whole.column(2).to_numpy()
            hit = (have[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1)
            yield whole.select([0, 1]).take(pa.array(np.flatnonzero(hit)))
            del whole
        tidy()

    place = F.pmod(F.xxhash64("cid"), F.lit(64 * len(have))).alias("p")
    return rows.where("text is not null").select(F.col("rid").alias("cid"), "text").select("cid", "text", place).mapInArrow(run, "cid long, text string")


def hashed_sets(texts: DataFrame) -> DataFrame:
    """(cid, words): the sorted shingle hashes of each text."""

    def run(batches):
        for b in sub_batches(batches, limit=BATCH_BYTES):
            data, offs = text_buffer(b.column(1))
            starts, ends, first = word_bounds(data, offs)
            h, row = shingle_sets(word_hashes(data, starts, ends, lower=True), first, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), binary_rows(h, np.searchsorted(row, np.arange(b.num_rows + 1)))], names=["cid", "words"])
        tidy()

    return texts.select("cid", "text").mapInArrow(run, "cid long, words binary")


def shingle_codes(ids: np.ndarray, kinds: int) -> np.ndarray:
    """Distinct codes of the shingles of words numbered below `kinds`, exact: equal codes are equal words."""
    if len(ids) < WIDTH:
        return np.zeros(0, np.int64)
    code = ids[: len(ids) - WIDTH + 1].copy()
    for j in range(1, WIDTH):
        code = code * kinds + ids[j : j + len(code)]
    return code


def both_sizes(x: list[bytes], y: list[bytes]) -> tuple[int, int, int]:
    """(shingles of x, of y, of both), told apart by their words."""
    number: dict[bytes, int] = {}
    p, q = (np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in (x, y))
    if min(len(p), len(q)) < WIDTH:
        return max(1, len(p) - WIDTH + 1), max(1, len(q) - WIDTH + 1), int(x == y and len(x) > 0)
    kinds = len(number)
    if kinds ** WIDTH < 2**62:
        a, b = np.unique(shingle_codes(p, kinds)), np.unique(shingle_codes(q, kinds))
    else:  # number the pairs, then the fours, then the fives
        cut, m = len(p), len(p) + len(q)
        flat = np.concatenate([p, q])
        two = np.unique(flat[:-1] * kinds + flat[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
        five = four[: m - WIDTH + 1] * kinds + flat[WIDTH - 1 :]
        a, b = np.unique(five[: cut - WIDTH + 1]), np.unique(five[cut:])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on the words of the whole texts."""

    def run(batches):
        last, x = None, []
        for b in batches:
            ok = []
            for k, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if k != last:  # pairs come sorted by a
                    last, x = k, s.as_buffer().to_pybytes().lower().split()
                n, m, both = both_sizes(x, t.as_buffer().to_pybytes().lower().split())
                ok.append(100 * both >= percent * (n + m - both))
            kept = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept)], names=["a", "b"])
        tidy()

    of = lambda s: texts.select(F.col("cid").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def by_key(rows: DataFrame, facts: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """rows joined with facts, one row a key whose column `n` counts the key's rows; hot keys by broadcast.

    A key is hot with more than 1 / HEAVY_KEYS of the rows, so fewer than HEAVY_KEYS rows are broadcast.
    """
    facts, _ = written(facts, "facts")
    total = facts.agg(F.sum(n)).collect()[0][0] or 0
    hot = F.col(n) * HEAVY_KEYS > total
    hot = hot & (F.col(n) > 100)
    few = facts.where(hot)
    heavy = rows.join(F.broadcast(few), key)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~hot), key)
    return heavy.unionByName(light)


def classes_of(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows = identified(docs, id_col, text_col)
    of_row = row_classes(rows, percent, miss)
    names = rows.select(F.col("rid").alias("first"), F.col("doc_id").alias("component_id"))
    out = of_row.join(rows.select("rid", "doc_id"), "rid").join(names, "first")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def row_classes(rows: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """rows (rid, text) -> (rid, n_shingles, first): first is the smallest rid of the row's component."""
    spark = rows.sparkSession
    sketches, _ = written(sketch(rows), "sketch")
    groups = sketches.where("n_shingles > 0").groupBy("k1", "k2")
    least = groups.agg(F.min(F.struct("rid", "n_shingles", "bands", "sig")).alias("x"))
    classes, _ = written(least.select("k1", "k2", F.col("x.rid").alias("cid"), F.col("x.n_shingles").alias("n"), "x.bands", "x.sig"), "classes")
    one = classes.select("cid", "n", "bands", "sig")
    test = Tester(rows, one, percent, miss)
    buckets = bands(one)
    for depth in (0, 1):
        big = buckets.groupBy("key").agg(F.min("cid").alias("p"), F.max("cid").alias("q")).where("p < q").select("key")
        held, _ = written(buckets.join(big, "key"), "buckets")
        test.link(_stars(held))
        open_, _ = written(_open(held, test.comp), "open")
        before = test.comp
        test.link(_stars(open_.where("comp <> main")).unionByName(_hubs(open_, test.links)).distinct())
        release(spark)
        if test.comp is not before:
            open_, _ = written(_open(open_.select("key", "fine", "cid"), test.comp), "open")
        many = F.col("outside") > FEW_OUTSIDE
        ids = open_.select("cid").distinct()
        texts, _ = written(texts_of(rows, ids).join(ids, "cid", "left_semi"), "open-texts")
        sets, _ = written(hashed_sets(texts), "open-sets")
        own, _ = written(own_shingles(sets), "own")
        rest = open_ if depth else open_.where(~many)
        far = _blocks(rest.where(F.col("size") > SMALL_BUCKET), sets, own, percent, miss)
        test.link(_across(rest.where(F.col("size") <= SMALL_BUCKET), one, own, percent), texts, far)
        if depth or open_.where(many).isEmpty():
            break
        buckets, _ = written(sub_bands(_open(open_.where(many).select("key", "fine", "cid"), test.comp).select("key", "cid"), one), "sub-bands")
    of_row = sketches.select("rid", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "cid"), ["k1", "k2"], "left")
    of_row = of_row.withColumn("cid", F.when(F.col("n_shingles") > 0, F.col("cid")))
    of_row = of_row.join(test.comp.select(F.col("u").alias("cid"), F.col("v")), "cid", "left")
    return of_row.select("rid", "n_shingles", F.coalesce("v", "cid", "rid").alias("first"))


def _stars(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the smallest one of its bucket, and of its finer bucket."""
    parts = []
    for key in ("key", "fine"):
        top = held.groupBy(key).agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.count(F.lit(1)).alias("_n")).where("a < z").drop("z")
        parts.append(by_key(held.select(key, F.col("cid").alias("b")), top, key).where("a < b").select("a", "b"))
    return parts[0].unionByName(parts[1]).distinct()


def _open(held: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, fine, cid, comp) of buckets with several components, the largest one (main), the
    number of members outside it, and the bucket's size."""
    of = held.join(comp.select(F.col("u").alias("cid"), F.col("v")), "cid", "left").select("key", "fine", "cid", F.coalesce("v", "cid").alias("comp"))
    per = of.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    return by_key(of, main.select("key", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.n")).alias("outside"), F.col("n").alias("size")), "key", "size")


def _hubs(open_: DataFrame, links: DataFrame, k: int = 4) -> DataFrame:
    """Pairs (a, b) of members outside a bucket's largest component with its k members of most links."""
    degree = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("d"))
    hubs = open_.where("comp = main").join(degree, "cid").select("key", "d", "cid", F.pmod(F.xxhash64("cid"), F.lit(256)).alias("part"))
    for place in (["key", "part"], ["key"]):  # the best of each part of a bucket, then of the bucket
        top = Window.partitionBy(*place).orderBy(F.desc("d"), "cid")
        hubs = hubs.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")
    hubs = hubs.groupBy("key").agg(F.collect_list("cid").alias("hubs"))  # k ids at most
    outside = open_.where("comp <> main").select("key", "cid")
    sizes = outside.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).join(hubs, "key")
    rows = by_key(outside, sizes, "key").select("cid", F.explode("hubs").alias("hub"))
    return rows.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()


PLANES, WORDS = 4, BINS // 64


def planes(classes: DataFrame) -> DataFrame:
    """(cid, n, bits): which bins are filled and, plane by plane, the low bits of their values, as longs."""

    def run(batches):
        for b in batches:
            sig = _matrix(b.column(2), "<u2", BINS)
            bits = [np.packbits(sig > 0, axis=1), *[np.packbits((sig >> np.uint16(i)) & np.uint16(1), axis=1) for i in range(1, PLANES + 1)]]
            words = np.concatenate(bits, axis=1).view(np.int64).reshape(-1)
            ends = pa.array(np.arange(b.num_rows + 1) * WORDS * (PLANES + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(words))], names=["cid", "n", "bits"])
        tidy()

    return classes.select("cid", "n", "sig").mapInArrow(run, "cid long, n long, bits array<long>")


def _alike(percent: int) -> str:
    """SQL: sizes and bits of rows x and y allow a link; four standard deviations below the threshold."""
    same, filled = [], []
    for w in range(WORDS):
        differ = " | ".join(f"(x.bits[{w + WORDS * p}] ^ y.bits[{w + WORDS * p}])" for p in range(1, PLANES + 1))
        same.append(f"bit_count(x.bits[{w}] & y.bits[{w}] & ~({differ}))")
        filled.append(f"bit_count(x.bits[{w}] | y.bits[{w}])")
    t, n = percent / 100, f"({' + '.join(filled)})"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {' + '.join(same)} >= {t} * {n} - 4 * sqrt({t * (1 - t)} * {n})"


def own_shingles(sets: DataFrame) -> DataFrame:
    """(cid, own): how many shingles of a set stand in no other one of the table."""

    def run(batches):
        for b in batches:
            for x in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                words = np.frombuffer(b"".join(x.column(1).to_pylist()), np.int64)
                size = [len(w) // 8 for w in x.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(x.column(0).to_numpy(), size))], names=["h", "cid"])
        tidy()

    each = sets.mapInArrow(run, "h long, cid long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid"))
    return each.where("n = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own"))


def _across(open_: DataFrame, classes: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members outside a bucket's largest component with those of other components, where
    size, shingles of their own and sketch bits, looked at inside the join, allow a link.

    An intersection is at most a set without the shingles that no other set of the table holds, and a
    link needs (100 + percent) * intersection >= percent * (sum of the sizes).
    """
    bits = planes(classes.join(open_.select("cid").distinct(), "cid", "left_semi"))
    rows = open_.join(bits, "cid").join(own, "cid", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    rows = rows.where(F.col("most") * 100 >= F.col("n") * percent).select("key", "cid", "comp", "main", "n", "most", "bits")
    x, y = rows.where("comp <> main").alias("x"), rows.alias("y")
    fits = F.expr(f"x.comp <> y.comp and (y.comp = y.main or x.cid < y.cid) and {100 + percent} * least(x.most, y.most) >= {percent} * (x.n + y.n) and {_alike(percent)}")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & fits).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _blocks(open_: DataFrame, sets: DataFrame, own: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) across components of large buckets: a block of members meets a block of outside members
    in one task, which prunes by sketches, counts intersections and gives the links alone.

    Buckets with the same members are looked at once.  A block has at most about BLOCK_MEMBERS members or
    BLOCK_OUTSIDE outside ones, and BLOCK_SHINGLES shingles; a bucket's rows are copied once per block of the
    other side.
    """
    need = least_matches(miss, percent)
    what = open_.groupBy("key").agg(F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("h"), F.max("size").alias("size"), F.max("outside").alias("outside"))
    once = what.groupBy("h", "size", "outside").agg(F.min("key").alias("key")).select("key")
    rows = open_.join(once, "key", "left_semi").select("key", "cid", "comp", "main", "size", "outside")
    rows = rows.join(own, "cid", "left").withColumn("own", F.coalesce("own", F.lit(0))).join(sets, "cid")
    weight = F.floor(F.octet_length("words") / 8)
    weights = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("w"), F.sum(F.when(F.col("comp") != F.col("main"), weight).otherwise(0)).alias("wo"))
    rows = by_key(rows, weights, "key")
    cells = lambda c, n, w: F.greatest(F.lit(1), F.ceil(F.col(c) / n), F.ceil(F.col(w) / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumns({"nm": cells("size", BLOCK_MEMBERS, "w"), "no": cells("outside", BLOCK_OUTSIDE, "wo")})
    place = F.xxhash64(F.lit(3), "cid")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumn("m", F.pmod(place, F.col("nm")).cast("int")).withColumn("o", each("no")).withColumn("out", F.lit(False))
    outside = rows.where("comp <> main").withColumn("o", F.pmod(place, F.col("no")).cast("int")).withColumn("m", each("nm")).withColumn("out", F.lit(True))
    columns = ["key", "m", "o", "out", "cid", "comp", "main", "own", "words"]

    def run(table: pa.Table) -> pa.Table:
        out = table.column("out").to_numpy(zero_copy_only=False)
        cid, comp, own = (table.column(c).to_numpy() for c in ("cid", "comp", "own"))
        main = table.column("main")[0].as_py()
        words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        n = np.array([len(w) for w in words])
        h, row = np.concatenate(words), np.repeat(np.arange(len(words)), n)
        sig = bins(h, row, len(words))
        x_at, y_at = np.flatnonzero(out), np.flatnonzero(~out)
        flat = np.concatenate([words[i] for i in y_at]) if len(y_at) else h[:0]
        known, code = np.unique(flat, return_inverse=True)
        first = np.cumsum(n[y_at]) - n[y_at]
        most = n - own
        found = []
        for x in x_at if len(y_at) else []:
            y = y_at
            ok = (comp[y] != comp[x]) & ((comp[y] == main) | (cid[x] < cid[y]))
            ok &= (100 + percent) * np.minimum(most[x], most[y]) >= percent * (n[x] + n[y])
            live = np.flatnonzero(ok)
            filled, seen = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
            for to in range(BATCH_BINS, BINS + 1, BATCH_BINS):
                p, q = sig[x, to - BATCH_BINS : to], sig[y[live], to - BATCH_BINS : to]
                some = (p | q) > 0
                filled[live] += some.sum(1)
                seen[live] += (some & (p == q)).sum(1)
                live = live[seen[live] >= need[filled[live]]]
            if not len(live):
                continue
            held = np.zeros(len(known), np.int64)
            at = np.searchsorted(known, words[x])
            hit = at < len(known)
            hit[hit] = known[at[hit]] == words[x][hit]
            held[at[hit]] = 1
            both = np.add.reduceat(held[code], first)[live]
            yes = live[100 * both >= percent * (n[x] + n[y[live]] - both)]
            found += [(min(cid[x], c), max(cid[x], c)) for c in cid[y[yes]]]
        tidy()
        return pa.table([pa.array([int(v[i]) for v in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    both = members.select(*columns).unionByName(outside.select(*columns))
    return both.groupBy("key", "m", "o").applyInArrow(run, "a long, b long").distinct()


class Tester:
    """Tests pairs and keeps links, tested pairs and components so far, each a written table."""

    def __init__(self, rows, classes, percent, miss):
        self.rows, self.classes, self.percent, self.miss = rows, classes, percent, miss
        self.links = self.tested = self.comp = None

    def link(self, pairs: DataFrame, texts: DataFrame | None = None, likely: DataFrame | None = None) -> None:
        """Test pairs, and verify those of `likely` too; texts: of their ids, if they are at hand."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs, _ = written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        left = prune(pairs, self.classes, self.miss, self.percent)
        left, _ = written(left if likely is None else left.unionByName(likely).distinct(), "survivors")
        if self.links is not None and left.isEmpty():
            return
        if texts is None:
            ids = left.select("a").unionByName(left.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "cid")
            texts, _ = written(texts_of(self.rows, ids), "texts")
        found, _ = written(verify(left, texts, self.percent), "links")
        if self.links is not None and found.isEmpty():
            return
        old = self.comp
        self.links = found if self.links is None else self.links.unionByName(found)
        self.comp = components(found if old is None else found.unionByName(old.select(F.col("u").alias("a"), F.col("v").alias("b"))))


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicate component of each document."""
    return classes_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS g FROM dw WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
e AS (SELECT i AS u, j AS v FROM k UNION SELECT j, i FROM k),
r AS (SELECT u AS doc_id, u AS reach FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of docs, that of the smallest doc_id, with docs' columns."""
    rows = identified(docs, id_col, text_col, others=True)
    gone = row_classes(rows.select("rid", "text"), **options).where("first <> rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select("doc.*")
