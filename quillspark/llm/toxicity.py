"""Toxicity: a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the whole word and of its first 4 and 7 bytes.
Filters of widths 1, 2 and 3 run over the words, are rectified and max-pooled over the whole text, and a logistic
layer turns the maxima into a score.  Because a filter's response is a sum over its places, embedding
and filter weights fold into one table per place, so that scoring is look-ups, sums and maxima.

Thresholds are calibrated by language: a text's language group comes from its own function words (fixed
lists below), never from a column.  For each group the threshold with the best F1 on all training
rows is found, on a grid of 1 / GRID of a logit, and the score's logit is shifted so that this threshold lies at 0.3.

Training reads every labelled row, whole texts as word hashes, EPOCHS times.  Rows are dealt by id into shards of about
SHARD rows; in each epoch every shard goes on from the common weights by small batches, and what the shards moved is
averaged: a word's embedding over the shards that moved it, the rest over all.  Sums are whole numbers, so
their order does not matter.  The driver holds one set of weights, whatever the number of rows.

Defined cases: null and empty texts score like a text without words; ids in labels that no document has,
null labels and repeated label rows (largest label counts) are no error; without labels of both kinds
all scores are 0; rows that repeat an id are scored each and learned from once; ids may be of any type that sorts; very long
texts are scored whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.langid import remainder
from quillspark.llm.shared import LOWER, MULTS, SUB_BATCH_BYTES, U64, drop_folder, mix, release, sub_batches, text_buffer, tidy, word_bounds, written

BITS = 15
BUCKETS = 1 << BITS
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 7)
EPOCHS = 12
BATCH = 32
SHARD = 4096  # rows that learn one after the other between two averages
HELD_BYTES = 48 << 20  # of a shard's words that are in memory and drawn from at once
PIECES = 64  # of the embeddings, summed apart
FIXED = float(1 << 32)  # sums are in units of 1 / FIXED
GRID = 256
CUT = 0.3
# All bytes but letters, digits, bytes of 0x80 and above part words.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x41:0x5B] = GAP[0x61:0x7B] = False
GAP[0x80:] = False
# Function words by which a text's language group is found.
GROUPS = {
    "en": "the of and to in is that for with this are was",
    "fr": "le la les des et un une du pour dans que est",
    "de": "der die das und den von ist im mit ein zu für",
    "es": "el los las de y en un una por con del que",
}

# Feature hashing to BUCKETS places: values of bytes times powers of an odd base, so that prefixes come from running sums.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(0x9E3779B97F4A7C15)
BASE_INV = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base & (2**64 - 1)))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, grown on demand and kept for one task."""

    def __init__(self):
        self.up = _powers(BASE, 1 << 16)
        self.down = _powers(BASE_INV, 1 << 16)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, min(2 * len(self.up), SUB_BATCH_BYTES + 4096))
            self.up, self.down = _powers(BASE, n), _powers(BASE_INV, n)


def features(data: np.ndarray, offs: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """([feature, word] buckets, first word of each row): the word itself, then its prefixes."""
    starts, ends, first = word_bounds(data, offs, GAP)
    out = np.zeros((1 + len(PREFIXES), len(starts)), np.uint16)
    if len(starts):
        powers.need(len(data) + 1)
        table = BYTE_VALUES[LOWER]
        table[GAP] = 0
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * powers.up[: len(data)])])
        for i, k in enumerate((0, *PREFIXES)):
            to = np.minimum(ends, starts + k) if k else ends
            h = mix((total[to] - total[starts]) * powers.down[starts] + MULTS[30 + i])
            out[i] = h >> U64(64 - BITS)
    return out, first


def group_words() -> np.ndarray:
    """[group, bucket] 0/1 of the function words' whole-word buckets."""
    out = np.zeros((len(GROUPS), BUCKETS), np.float32)
    for g, words in enumerate(GROUPS.values()):
        data = np.frombuffer(words.encode(), np.uint8)
        f, _ = features(data, np.array([0, len(data)]), Powers())
        out[g, f[0]] = 1
    return out


def groups_of(f: np.ndarray, first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each row's language group: the one with most function words; the first if there are none."""
    if not f.shape[1]:
        return np.zeros(len(first) - 1, np.int64)
    hits = np.concatenate([np.zeros((len(marks), 1)), np.cumsum(marks[:, f[0]], axis=1, dtype=np.float64)], axis=1)
    return (hits[:, first[1:]] - hits[:, first[:-1]]).argmax(0)


class Net:
    """embed [bucket, dim]; filters[w] [w, dim, filter]; bias[w] [filter]; out [maxima], out_bias."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.out_bias = np.float32(-1.5)
        self.shift = np.zeros(len(GROUPS))

    def fold(self):
        """Per width, [place, bucket, filter]: what a word's bucket adds at a place of the filter."""
        self.folded = [np.einsum("bd,wdf->wbf", self.embed, f) for f in self.filters]

    def maxima(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[row, maxima] by the folded tables; rows shorter than a filter see empty words after it."""
        rows, n = len(first) - 1, f.shape[1]
        out = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32)
        held = np.flatnonzero(np.diff(first))
        if not n:
            return out
        last = np.repeat(first[1:], np.diff(first))
        for i, w in enumerate(WIDTHS):
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                m = n - j
                add = sum(self.folded[i][j][x[j:]] for x in f)
                if j:
                    add[np.arange(m) + j >= last[:m]] = 0
                total[:m] += add
            total = np.maximum(total + self.bias[i], 0)
            out[held, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(total, first[:-1][held], axis=0)
        return out

    def logits(self, f, first):
        return self.maxima(f, first) @ self.out + self.out_bias


class Learner:
    """A net in training: Adam for what is dense, a step size a row for embeddings; weighted logistic loss, maxima's gradients only."""

    def __init__(self, counts: tuple[int, int], seed: int = 5):
        self.net, self.seed = Net(seed), seed
        self.weight = 0.5 * sum(counts) / np.maximum(1, counts)  # of rows without and with the label
        sizes = [p.shape for p in self._params()]
        self.m1, self.m2 = [np.zeros(x, np.float32) for x in sizes], [np.zeros(x, np.float32) for x in sizes]
        self.e2 = np.zeros(BUCKETS, np.float32)
        self.step, self.rate = 0.0, 0.01

    def _params(self) -> list[np.ndarray]:
        return [*self.net.filters, *self.net.bias, self.net.out]

    def dense(self) -> np.ndarray:
        return np.concatenate([*(x.ravel() for x in (*self._params(), *self.m1, *self.m2)), [self.net.out_bias, self.step]]).astype(np.float64)

    def words(self) -> np.ndarray:
        return np.concatenate([self.net.embed, self.e2[:, None]], axis=1).astype(np.float64)

    def put(self, dense: np.ndarray, words: np.ndarray) -> None:
        self.net.embed, self.e2 = words[:, :DIM].astype(np.float32), np.maximum(words[:, DIM], 0).astype(np.float32)
        at = 0
        for x in (*self._params(), *self.m1, *self.m2):
            x[...] = dense[at : at + x.size].reshape(x.shape)
            at += x.size
        for x in self.m2:
            np.maximum(x, 0, out=x)
        self.net.out_bias, self.step = np.float32(dense[-2]), float(dense[-1])

    def batch(self, texts: list[np.ndarray], labels: np.ndarray, rng) -> None:
        """One step over texts, [feature, word] each."""
        net, most = self.net, max(WIDTHS) - 1
        sizes = np.array([max(1, f.shape[1]) for f in texts])
        first = np.concatenate([[0], np.cumsum(sizes + most)])
        word = np.full(int(first[-1]), -1)  # each place's word; empty places follow a text
        f = np.concatenate(texts, axis=1)
        for i, x in zip(first[:-1], texts, strict=True):
            word[i : i + x.shape[1]] = 1
        held = np.flatnonzero(word > 0)
        word[held] = np.arange(len(held))
        x = net.embed.take(f[0], axis=0, mode="clip")  # in bounds by its type
        for other in f[1:]:
            x += net.embed.take(other, axis=0, mode="clip")
        wide = np.zeros((len(word), DIM), np.float32)
        wide[held] = x
        # all places of all filters at once, then those of one filter summed
        parts = np.concatenate([p.T for filters in net.filters for p in filters]) @ wide.T
        z, row = np.empty((len(WIDTHS) * FILTERS, len(word)), np.float32), 0
        for k, w in enumerate(WIDTHS):
            own = z[k * FILTERS : (k + 1) * FILTERS]
            np.add(parts[row : row + FILTERS], net.bias[k][:, None], out=own)
            for j in range(1, w):
                own[:, :-j] += parts[row + j * FILTERS : row + (j + 1) * FILTERS, j:]
            row += w * FILTERS
        top = np.stack([x + z[:, x : x + n].argmax(1) for x, n in zip(first[:-1].tolist(), sizes.tolist(), strict=True)])
        v = z[np.arange(len(z)), top]
        v[[not f.shape[1] for f in texts]] = 0  # as maxima() has it
        h = np.maximum(v, 0)
        drop = (rng.random(h.shape) < 0.8) / np.float32(0.8)
        logit = (h * drop) @ net.out + net.out_bias
        g = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * self.weight[labels] / len(texts)).astype(np.float32)
        gh = (g[:, None] * net.out * drop * (v > 0)).astype(np.float32)
        grads, ids, moves = [np.zeros_like(p) for p in self._params()], [], []
        grads[-1] += (g[:, None] * h * drop).sum(0)
        for k, w in enumerate(WIDTHS):
            c = slice(k * FILTERS, (k + 1) * FILTERS)
            grads[len(WIDTHS) + k] += gh[:, c].sum(0)
            for j in range(w):
                place = top[:, c] + j
                grads[k][j] += np.einsum("rfd,rf->df", wide[place], gh[:, c])
                some = (word[place] >= 0) & (gh[:, c] != 0)
                ids.append(word[place[some]])
                moves.append((gh[:, c, None] * net.filters[k][j].T)[some])
        self.step += 1
        for p, d, a, b in zip(self._params(), grads, self.m1, self.m2, strict=True):
            a *= 0.9
            a += 0.1 * d
            b *= 0.999
            b += 0.001 * d * d
            p -= self.rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-6)
        net.out_bias -= np.float32(self.rate * g.sum())
        ids, moves = np.concatenate(ids), np.concatenate(moves)
        if len(ids):
            touched = f[:, ids].ravel()
            order = np.argsort(touched, kind="stable")
            own, at = np.unique(touched[order], return_index=True)
            d = np.add.reduceat(moves[order % len(ids)], at, axis=0)
            self.e2[own] += (d * d).mean(1)
            net.embed[own] -= 0.05 * d / (np.sqrt(self.e2[own])[:, None] + 1e-6)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rng) -> None:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self.batch([texts[i] for i in some], labels[some], rng)


def _unpacked(cells) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(1 + len(PREFIXES), -1) for x in cells.to_pylist()]


def epoch(rows: DataFrame, learner: Learner, number: int) -> None:
    """Every shard of rows goes on from the learner's weights; the learner gets the averages."""

    def run(batches):
        dense, words = learner.dense(), learner.words()
        sums, moved = np.zeros(len(dense) + 1, np.int64), np.zeros((BUCKETS, DIM + 2), np.int64)
        shard, texts, labels, size, rng = None, [], [], 0, None

        def study():
            nonlocal texts, labels, size
            learner.learn(texts, np.array(labels), rng)
            texts, labels, size = [], [], 0

        def add():
            study()
            sums[:-1] += np.rint((learner.dense() - dense) * FIXED).astype(np.int64)
            sums[-1] += 1
            step = np.rint((learner.words() - words) * FIXED).astype(np.int64)
            moved[:, :-1] += step
            moved[:, -1] += step.any(axis=1)
            learner.put(dense, words)

        for b in batches:
            f = _unpacked(b.column(2))
            for s, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), f, strict=True):
                if s != shard:
                    if shard is not None:
                        add()
                    shard, rng = s, np.random.default_rng([learner.seed, number, s])
                texts.append(x)
                labels.append(y)
                size += x.nbytes
                if size >= HELD_BYTES:
                    study()
        if shard is None:
            return
        add()
        pieces = [*np.split(moved, PIECES), sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "v"])
        tidy()

    def total(batches):
        held = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, np.int64)
                held[k] = held[k] + v if k in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "v"])

    kind = "piece int, v binary"
    got = {r["piece"]: np.frombuffer(r["v"], np.int64) for r in rows.select("shard", "toxic", "f").mapInArrow(run, kind).repartition("piece").mapInArrow(total, kind).collect()}
    moved = np.concatenate([got[k] for k in range(PIECES)]).reshape(BUCKETS, DIM + 2)
    sums = got[PIECES]
    learner.put(learner.dense() + sums[:-1] / FIXED / sums[-1], learner.words() + moved[:, :-1] / FIXED / np.maximum(1, moved[:, -1:]))
    learner.rate *= 0.85


def _best(cells: list) -> float:
    """The threshold of best F1 of (bin, rows, hits); a bin holds logits from bin / GRID on."""
    at, rows, hits = np.array(sorted(cells, reverse=True)).T
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())
    k = int(f1.argmax())
    low = (at[k + 1] + 1) / GRID if k + 1 < len(at) else at[k] / GRID - 1
    return (at[k] / GRID + low) / 2


def calibrate(net: Net, rows: DataFrame) -> None:
    """Shift each language group's logits so that its threshold of best F1 over all rows lies at the cut."""

    def run(batches):
        net.fold()
        marks = group_words()
        for b in batches:
            texts, y = _unpacked(b.column(1)), b.column(0).to_numpy()
            ends, x = np.cumsum([f.shape[1] for f in texts]), 0
            while x < len(texts):  # about SUB_BATCH_BYTES of words at a time, a text at least
                to = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + SUB_BATCH_BYTES // 8, "right")))
                first = np.concatenate([[0], np.cumsum([f.shape[1] for f in texts[x:to]])])
                f = np.concatenate(texts[x:to], axis=1)
                z = np.floor(np.clip(net.logits(f, first), -40, 40) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(groups_of(f, first, marks)), pa.array(z), pa.array(y[x:to])], names=["g", "z", "y"])
                x = to

    net.folded = None
    # at most 80 * GRID cells a group
    cells = rows.select("toxic", "f").mapInArrow(run, "g long, z int, y int").groupBy("g", "z").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).collect()
    cut, every = np.log(CUT / (1 - CUT)), {}
    for r in cells:
        n, hits = every.get(r["z"], (0, 0))
        every[r["z"]] = (n + r["n"], hits + r["hits"])
    everywhere = _best([(z, *x) for z, x in every.items()])
    for k in range(len(GROUPS)):
        own = [(r["z"], r["n"], r["hits"]) for r in cells if r["g"] == k]
        enough = sum(x[1] for x in own) >= 50 and sum(x[2] for x in own) >= 10
        net.shift[k] = cut - (_best(own) if enough else everywhere)


def known_labels(labels: DataFrame, id_col="doc_id", label_col="toxic") -> DataFrame:
    """(doc_id, toxic): the largest label of each id."""
    return labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learned(docs: DataFrame, known: DataFrame, shards: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, toxic, f: word features, shard) of all documents with a label; of rows with one id, one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        powers = Powers()
        for b in sub_batches(batches):
            at = b.schema.get_field_index
            f, first = features(*text_buffer(b.column(at("text"))), powers)
            yield pa.RecordBatch.from_arrays([b.column(at("doc_id")), b.column(at("toxic")), pa.array([f[:, x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "toxic", "f"])
        tidy()

    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    # dealt once, for join, grouping and shards
    rows = picked.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id"), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("doc_id", "text", "toxic").sortWithinPartitions("doc_id")
    return rows.mapInArrow(pack, f"doc_id {kind}, toxic int, f binary").withColumn("shard", F.spark_partition_id())


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[list[np.ndarray], np.ndarray]:
    """Word features and labels of at most per_class documents of each label, by hash order, to look at; training takes all."""
    known = known_labels(labels, id_col, label_col)
    ids = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for y in (0, 1)]
    rows = learned(docs, ids[0].unionByName(ids[1]), 1, id_col, text_col).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    return [np.frombuffer(r["f"], np.uint16).reshape(1 + len(PREFIXES), -1) for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", shard: int = SHARD) -> Net | None:
    """Learned from every document with a label."""
    spark = docs.sparkSession
    known = known_labels(labels, id_col, label_col)
    rows, path = written(learned(docs, known, max(1, -(-known.count() // shard)), id_col, text_col), "toxicity")
    release(spark)  # the texts that were shuffled
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    net = None
    if len(count) == 2:
        learner = Learner((count[0], count[1]))
        for k in range(EPOCHS):
            epoch(rows, learner, k)
        net = learner.net
        calibrate(net, rows)
    drop_folder(spark, path)
    return net


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        powers, marks = Powers(), group_words()
        if net is not None:
            net.fold()
        for b in sub_batches(batches, limit=1 << 20):
            if net is None:
                s = np.zeros(b.num_rows)
            else:
                f, first = features(*text_buffer(b.column(1)), powers)
                z = net.logits(f, first) + net.shift[groups_of(f, first, marks)]
                s = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])
        tidy()

    if net is not None:
        net.folded = None  # made again where it is used
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned from rows whose remainder by 4 is not 2, applied to all rows."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    # a text is dealt out only where it may be learned from
    net = fit(docs.where(remainder("doc_id", 4) != 2), labels.where(remainder("doc_id", 4) != 2))
    return score(docs, net).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
