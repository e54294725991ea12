"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each document is cut into blocks of at most `block_words` words; most documents are one block.  A seeded hash
of a row's number and the block's place permutes the blocks of each source.  The target of a source fixes how
many blocks it gives: whole passes over the permutation plus a part of the next one, the last block cut to the
word.  A tree over the output shards then splits the vector of block quotas: every node draws its left
half's share with a multivariate-hypergeometric law, so shard totals are even and source totals exact.  A
shard draws the run of permuted blocks that its quotas give it, disjoint from all others, and shuffles
what it drew by another hash.  What is taken is what the shards drew.

Ranks in the permutation are found without sorting a source: block counts per range of hashes, then
counts inside the ranges that hold a border between shards, give each border's exact hash; a block's shard
follows from its own hash.  The driver sees, for each source, some numbers for each of 1,024 ranges and each
border; sources are taken to be few (a name each in a list), as targets are reshared among all of them.

Defined cases: a null text has size 0; a null source is one source, last in the order; an empty table
gives no rows; a source without words has target 0; repeated rows count as rows of their own; ids may be of
any type that sorts; other columns are kept out of the plan.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import identified, sub_batches, text_buffer, word_bounds, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 1024
FEW_ROWS = 16
SHARDS = 16
MOST_URN = 10**9
CELL_BITS, PLACE_BITS = 10, 58


def word_counts(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size): the words of each text, counted on its Arrow buffer."""

    def count(batches):
        for b in sub_batches(batches):
            data, offs = text_buffer(b.column(b.schema.get_field_index("text")))
            size = np.diff(word_bounds(data, offs)[2]) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size, pa.int64())], names=["rid", "doc_id", "source", "size"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("rid", "doc_id", "source", "text").mapInArrow(count, f"rid long, doc_id {kind}, source string, size long")


def targets(sizes: list[tuple], weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Target words of sources given as (name, size) in order, by refilling what capped ones leave."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = share * sum(s for _, s in sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i][1]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """One draw.  Beyond the generator's range by inversion: the law's values follow from their ratios, over
    twelve standard deviations about its mode (what lies beyond has a chance below 1e-30)."""
    if draws <= 0 or good <= 0:
        return 0
    n = good + bad
    if n < MOST_URN:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * good / n
    reach = int(12 * np.sqrt(max(1.0, mean * (bad / n) * ((n - draws) / (n - 1))))) + 12
    low, high = max(0, draws - bad, int(mean) - reach), min(good, draws, int(mean) + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def split_quotas(quotas: list[int], shards: int, seed: int = 7) -> np.ndarray:
    """quotas[source] -> [shard, source]; columns sum to the quotas, rows differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = sum(quotas)
    ends = [total * i // shards for i in range(shards + 1)]

    def down(lo: int, hi: int, q: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        need, rest, left = ends[mid] - ends[lo], sum(q), []
        for x in q:
            rest -= x
            got = _hypergeometric(rng, x, rest, need)
            left.append(got)
            need -= got
        down(lo, mid, left)
        down(mid, hi, [a - b for a, b in zip(q, left, strict=True)])

    down(0, shards, [int(x) for x in quotas])
    return out


def _place(seed: int) -> F.Column:
    """A block's place in the permutation, PLACE_BITS of a hash of its row and its number there."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "rid", "block"), 64 - PLACE_BITS)


def blocks_of(sizes: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(sid, rid, block, words, place) of all blocks."""
    each = sizes.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))))
    return each.select("sid", "rid", "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), _place(seed).alias("place"))


def find_borders(blocks: DataFrame, wanted: list[tuple[int, str, int]]) -> list[dict]:
    """For each (sid, 'n' or 'words', x): the first block, in the order of places, up to and with which the
    source's count of blocks or of words is above x: its place, words, and the sums n0, words0 before it.

    Each level counts the children of the ranges that still matter, 1,024 a range, until a range has a few
    blocks, which are then looked at one by one.
    """
    if not wanted:
        return []
    spark = blocks.sparkSession
    state = [{"cell": 0, "n0": 0, "words0": 0, "n": None} for _ in wanted]
    depth = 0
    while depth * CELL_BITS < PLACE_BITS - CELL_BITS and any(s["n"] is None or s["n"] > FEW_ROWS for s in state):
        inside = _inside(spark, blocks, wanted, state, depth)
        depth += 1
        found = inside.withColumn("cell", F.shiftright("place", PLACE_BITS - depth * CELL_BITS)).groupBy("sid", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()
        found.sort(key=lambda r: (r["sid"], r["cell"]))
        for (sid, what, x), s in zip(wanted, state, strict=True):
            lo = s["cell"] << CELL_BITS
            for r in found[bisect_left(found, (sid, lo), key=lambda r: (r["sid"], r["cell"])) :]:
                if r["sid"] != sid or r["cell"] >= lo + (1 << CELL_BITS):
                    raise ValueError(f"source {sid} has no more than {x} {what}")
                if s[f"{what}0"] + r[what] > x:
                    s["cell"], s["n"] = r["cell"], r["n"]
                    break
                s["n0"] += r["n"]
                s["words0"] += r["words"]
    rows = sorted(_inside(spark, blocks, wanted, state, depth).select("sid", "place", "rid", "block", "words").collect())
    out = []
    for (sid, what, x), s in zip(wanted, state, strict=True):
        for r in rows[bisect_left(rows, (sid, s["cell"] << (PLACE_BITS - depth * CELL_BITS)), key=lambda r: (r["sid"], r["place"])) :]:
            if s[f"{what}0"] + (1 if what == "n" else r["words"]) > x:
                out.append({"place": r["place"], "words": r["words"], "n0": s["n0"], "words0": s["words0"]})
                break
            s["n0"] += 1
            s["words0"] += r["words"]
    return out


def _inside(spark, blocks: DataFrame, wanted: list, state: list, depth: int) -> DataFrame:
    """The blocks in the ranges that the search has come to."""
    if not depth:
        return blocks
    cells = sorted({(w[0], s["cell"]) for w, s in zip(wanted, state, strict=True)})
    cells = F.broadcast(spark.createDataFrame(cells, "sid int, cell long"))  # a row for each border at most
    return blocks.withColumn("cell", F.shiftright("place", PLACE_BITS - depth * CELL_BITS)).join(cells, ["sid", "cell"], "left_semi").drop("cell")


class Plan:
    """sizes: (rid, doc_id, source, sid, size); facts: a row for each source; draws(): what the shards draw."""

    def __init__(self, sizes: DataFrame, facts: DataFrame, block_words: int, shards: int, seed: int):
        self.sizes, self.facts, self.block_words, self.shards, self.seed = sizes, facts, block_words, shards, seed

    def draw(self, blocks: DataFrame) -> DataFrame:
        """blocks (sid, rid, block, words, place, ...) -> each draw: pass, shard, place in it, and words (cut in
        a part pass's last block)."""
        of = blocks.join(F.broadcast(self.facts.select("sid", "whole", "part_place", "part_words", "borders")), "sid")
        last = F.col("whole") - F.when(F.col("place") <= F.col("part_place"), 0).otherwise(1)
        of = of.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
        code = F.shiftleft(F.col("pass").cast("long"), PLACE_BITS) + F.col("place")
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, self.shards.bit_length())))])
        shard = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= F.size("borders")) & (F.get("borders", lo + s - 1) <= F.col("_code")), lo + s).otherwise(lo))
        of = of.withColumn("_code", code).withColumn("shard", shard)
        cut = (F.col("pass") == F.col("whole")) & (F.col("place") == F.col("part_place"))
        of = of.withColumn("words", F.when(cut, F.col("part_words")).otherwise(F.col("words")))
        order = F.xxhash64(F.lit(self.seed + 1), "rid", "block", "pass")
        return of.withColumn("place", order).drop("_code", "whole", "part_place", "part_words", "borders")

    def draws(self) -> DataFrame:
        """(sid, rid, block, words, place, pass, shard)."""
        return self.draw(blocks_of(self.sizes, self.block_words, self.seed))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST_PASSES, block_words=BLOCK_WORDS, shards=SHARDS, seed=7) -> Plan:
    """The plan of the mix of docs."""
    return _plan(_rows(docs, id_col, text_col, source_col), weights, share, most, block_words, shards, seed)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(rid, doc_id, text, source, doc)."""
    return identified(docs, id_col, text_col, others=True).withColumn("source", F.col("doc")[source_col].cast("string"))


def _plan(rows: DataFrame, weights, share, most, block_words, shards, seed) -> Plan:
    spark = rows.sparkSession
    counted, _ = written(word_counts(rows), "mix-sizes")
    nb = F.ceil(F.col("size") / block_words).cast("long")
    per_source = counted.groupBy("source").agg(F.sum("size").alias("size"), F.sum(nb).alias("nb")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    want = targets([(r["source"], r["size"]) for r in per_source], weights, share, most)
    names = spark.createDataFrame([(i, r["source"], r["size"], t) for i, (r, t) in enumerate(zip(per_source, want, strict=True))], "sid int, source string, source_size long, target double")
    sizes = counted.join(F.broadcast(names), counted["source"].eqNullSafe(names["source"])).drop(names["source"])
    blocks = blocks_of(sizes, block_words, seed)
    whole = [int(t // r["size"]) if r["size"] else 0 for r, t in zip(per_source, want, strict=True)]
    rest = [round(t - w * r["size"]) for r, t, w in zip(per_source, want, whole, strict=True)]
    parts = [i for i, x in enumerate(rest) if x > 0]
    part = dict(zip(parts, find_borders(blocks, [(i, "words", rest[i] - 1) for i in parts]), strict=True))
    quotas = [w * r["nb"] + (part[i]["n0"] + 1 if i in part else 0) for i, (w, r) in enumerate(zip(whole, per_source, strict=True))]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)[:-1]
    ranks = {(i, int(g) % per_source[i]["nb"]) for i in range(len(quotas)) for g in ends[:, i] if quotas[i] and g < quotas[i]}
    ranks = sorted(ranks)
    place = dict(zip(ranks, (b["place"] for b in find_borders(blocks, [(i, "n", x) for i, x in ranks])), strict=True))
    top = (1 << 63) - 1

    def code(i: int, g: int) -> int:
        if not quotas[i] or g >= quotas[i]:
            return top
        passes, rank = divmod(g, per_source[i]["nb"])
        return (passes << PLACE_BITS) + (place[i, rank] if rank else 0)

    facts = [(i, whole[i], part[i]["place"] if i in part else -1, rest[i] - part[i]["words0"] if i in part else 0, [code(i, int(g)) for g in ends[:, i]]) for i in range(len(quotas))]
    return Plan(sizes, spark.createDataFrame(facts, "sid int, whole int, part_place long, part_words long, borders array<long>"), block_words, shards, seed)


def shuffled(draws: DataFrame, shards: int = SHARDS, pieces: int = 8) -> DataFrame:
    """The draws in output order: by shard, then by the seeded place; a shard spans `pieces` tasks."""
    part = F.col("shard") * pieces + F.floor((F.shiftrightunsigned("place", 8) / float(1 << 56)) * pieces).cast("int")
    signed = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    return draws.repartitionById(shards * pieces, part).sortWithinPartitions("shard", signed)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with its source's target and the words the shards drew of it."""
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = plan.draws().groupBy("rid").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).alias("shards"))
    rows = plan.sizes.join(taken, "rid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).cast("long").alias("shards"))


def cut_blocks(rows: DataFrame, block_words: int, text_col: str) -> DataFrame:
    """(rid, source, block, words, text, doc without its text): a text's blocks joined are the text."""
    names = [c for c in rows.schema["doc"].dataType.names if c != text_col]
    rest = F.struct(F.lit(0).alias("_"), *[F.col("doc")[c].alias(c) for c in names])
    picked = rows.select("rid", "source", rest.alias("doc"), "text").where("text is not null")

    def run(batches):
        for b in sub_batches(batches):
            data, offs = text_buffer(b.column(3))
            starts, _, first = word_bounds(data, offs)
            size = np.diff(first)
            n = -(-size // block_words)
            row = np.repeat(np.arange(b.num_rows), n)
            block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.where(block == 0, offs[row], starts[np.minimum(first[row] + block * block_words, max(0, len(starts) - 1))] if len(starts) else 0)
            end = np.where(block == n[row] - 1, offs[row + 1], np.append(begin[1:], 0))
            words = np.minimum(block_words, size[row] - block * block_words)
            raw = data.tobytes()
            texts = pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(block, pa.int64()), pa.array(words, pa.int64()), texts, b.column(2).take(at)], names=["rid", "source", "block", "words", "text", "doc"])

    kind = picked.schema["doc"].dataType
    out = T.StructType([T.StructField("rid", T.LongType()), T.StructField("source", T.StringType()), T.StructField("block", T.LongType()), T.StructField("words", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc", kind)])
    return picked.mapInArrow(run, out)


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST_PASSES, block_words=BLOCK_WORDS, shards=SHARDS, seed=7) -> DataFrame:
    """What the shards drew, with docs' columns, by shard and shuffled inside it: a row for each block drawn.

    A document of at most block_words words is one block, its text unchanged; a longer one comes as several
    rows.  The part pass's last block of a source is cut to the word.  n_chars, where present, follows the text.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    plan = _plan(rows, weights, share, most, block_words, shards, seed)
    names = F.broadcast(plan.sizes.select(F.col("source").alias("_s"), "sid").distinct())  # a row for each source
    blocks = cut_blocks(rows, block_words, text_col).withColumn("full", F.col("words")).withColumn("place", _place(seed))
    blocks = blocks.join(names, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    drawn = shuffled(plan.draw(blocks), shards)
    some = F.array_join(F.expr(r"slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), 1, cast(words as int))"), " ")
    drawn = drawn.withColumn("text", F.when(F.col("words") < F.col("full"), some).otherwise(F.col("text")))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    columns = {c: F.col("doc")[c] for c in docs.columns if c != text_col} | {text_col: F.col("text").cast(kinds[text_col])}
    if "n_chars" in kinds:
        columns["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return drawn.select(*[columns[c].alias(c) for c in docs.columns])
