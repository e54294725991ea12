"""Token-ID output: a corpus as one stream of ids in rANS-coded blocks, and the way back.

A folder of the format holds `table` (one row: the shared frequencies and the tokenizer's facts) and
`blocks` (Parquet; one row is one independent block of whole documents, in ascending doc_id order):
start (ids before it in the stream), doc_ids, doc_lens, words (coder output), checkpoints (states and
places where decoding may begin) and crc (crc32 of the block's ids as little-endian 32-bit integers).

Writing: texts are range-partitioned and sorted by doc_id, tokenized once, and written as a temporary
id table that also carries each document's offset in its partition; ids are counted over the whole
table; blocks are coded from it.  The driver sees one number for each range partition and one for each
vocabulary entry.

Tokenizing splits a text where a white-space character follows another character, or an ASCII sign other than
the apostrophe an ASCII letter, which the byte-level pre-tokenizer never joins, and tokenizes each distinct piece once per worker.  Pieces are told apart by
their bytes.  The text of a special token gives the token's id, as the tokenizers library has it.

Defined cases: null and empty texts give the end id alone; rows that repeat a doc_id come in order of
their texts, null first; an empty table writes no blocks; other columns are not read; a block whose
crc differs raises an error.
"""

from __future__ import annotations

import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import rans
from quillspark.llm.shared import SPACE, binary_rows, drop_folder, new_folder, release, sub_batches, text_buffer, tidy

END_ID = 0
BLOCK_IDS = 1 << 16
BATCH_IDS = 1 << 22
CACHE_PIECES, CACHE_BYTES = 1_500_000, 32 << 20
RUN_PIECES = 64
TEXT_BYTES = 2 << 20
GAP = SPACE.copy()
GAP[0x1C:0x20] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
SIGN = np.zeros(256, bool)
SIGN[0x21:0x7F] = True
SIGN[0x30:0x3A] = SIGN[0x27] = False
SIGN &= ~LETTER


class Tokens:
    """A tokenizer with a cache of pieces, one for each worker process and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sign = SIGN.copy()  # nothing is cut inside the text of a special token
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.sign[list(token.content.encode())] = False
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # byte-level vocabularies have one character a byte
            self.lengths[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}  # a piece's number
        self.held = 0  # bytes of known pieces
        self.place, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def of(path: str) -> Tokens:
        import tokenizers

        known = tokenizers.__dict__.setdefault("_quillspark", {})
        if path not in known:
            known[path] = Tokens(path)
        return known[path]

    def _learn(self, texts: list[bytes], joinable: np.ndarray) -> None:
        """Tokenize new pieces.  Joinable ones go in long runs, cut again by their tokens' lengths."""
        pieces, counts = [], np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)])
        joined = int(joinable.sum())
        for at in range(0, joined, RUN_PIECES):
            some = order[at : min(joined, at + RUN_PIECES)]
            ids, counts[some] = self._run([texts[i] for i in some])
            pieces.append(ids)
        for at in range(joined, len(order), RUN_PIECES):
            some = order[at : at + RUN_PIECES]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                pieces.append(np.array(e.ids, np.uint32))
                counts[i] = len(pieces[-1])
        pieces = np.concatenate(pieces)
        while self.filled + len(pieces) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(pieces)] = pieces
        at = len(self.known)
        while at + len(texts) > len(self.place):
            self.place, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.count))
        self.place[at + order] = self.filled + np.cumsum(counts[order]) - counts[order]
        self.count[at : at + len(texts)] = counts
        self.filled += len(pieces)
        self.known.update(zip(texts, range(at, at + len(texts)), strict=True))
        self.held += sum(map(len, texts))

    def _run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of joinable pieces, as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(texts).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right"), prepend=0)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per row) of the texts in an Arrow buffer, without end ids."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        # a white-space byte after a character that is no white space (nor one of 1C to 1F)
        plain = ~GAP[data]
        at = np.flatnonzero(SPACE[data[1:]] & plain[:-1]) + 1
        high = at[data[at - 1] >= 0x80]
        if len(high):
            a, b, c = data[high - 1], data[np.maximum(high - 2, 0)], data[np.maximum(high - 3, 0)]
            wide = ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE2) & (b <= 0x81)) | ((c == 0xE3) & (b == 0x80))
            at = np.setdiff1d(at, high[wide], assume_unique=True)
        cut = np.zeros(n, bool)
        cut[at] = True
        opens = cut.copy()  # no pre-token spans such a place, whatever stands before it
        # ASCII signs after an ASCII letter begin a pre-token too (but for apostrophes, which contractions take)
        cut[np.flatnonzero(self.sign[data[1:]] & LETTER[data[:-1]]) + 1] = True
        closes = cut.copy()
        cut[offs[:-1][offs[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.clear()
        at = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            first = np.empty(len(pieces), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            some = first[new]
            closes = np.append(closes, False)
            self._learn([pieces[i] for i in new.tolist()], opens[starts[some]] & closes[ends[some]])
        count = self.count[at][codes]
        done = np.cumsum(count)
        ids = self.pool[np.repeat(self.place[at][codes] - (done - count), count) + np.arange(int(done[-1]))]
        per_row = np.concatenate([[0], done])[np.searchsorted(starts, offs)]
        return ids, per_row


def _id_table(docs: DataFrame, path: str, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(table, width of an id); the table: doc_id, part, local (ids before it in its range partition), n, ids (end id included)."""
    spark = docs.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = picked.repartitionByRange(pieces, "doc_id").sortWithinPartitions("doc_id", "text")

    def tokenize(batches):
        tokens, part, local = Tokens.of(path), TaskContext.get().partitionId(), 0
        for b in sub_batches(batches, limit=TEXT_BYTES):
            ids, bounds = tokens.encode(*text_buffer(b.column(1)))
            rows = b.num_rows
            ids = np.insert(ids, bounds[1:], END_ID)
            bounds = bounds + np.arange(rows + 1)
            starts = local + bounds[:-1]
            local += int(bounds[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(rows, part), pa.int32()), pa.array(starts, pa.int64()), pa.array(np.diff(bounds), pa.int64()), binary_rows(ids.astype("<u4"), bounds)], names=["doc_id", "part", "local", "n", "ids"])

    def narrow(batches):  # 16 bits an id where the vocabulary allows
        for b in tokenize(batches):
            raw = np.frombuffer(b.column(4).buffers()[2], "<u4")
            bounds = np.concatenate([[0], np.cumsum(b.column(3).to_numpy())])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], binary_rows(raw.astype("<u2"), bounds)], names=b.schema.names)
        tidy()

    small = Tokens.of(path).tokenizer.get_vocab_size() <= 1 << 16
    return dealt.mapInArrow(narrow if small else tokenize, f"doc_id {kind}, part int, local long, n long, ids binary"), "<u2" if small else "<u4"


def write_stream(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write docs as a token stream to the folder `out` (see the module's text)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    temp = new_folder(spark, "ids")
    table, width = _id_table(docs, tokenizer, id_col, text_col)
    table.write.option("compression", "zstd").parquet(temp + "/t")
    release(spark)
    ids = spark.read.schema(table.schema).parquet(temp + "/t")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            seen = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    size = max((r["id"] for r in counts), default=0) + 1
    seen = np.zeros(size, np.int64)
    for r in counts:
        seen[r["id"]] = r["n"]
    freq = rans.scaled(seen)
    parts = sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for part, n in parts:
        base[part] = at
        at += n
    facts = [(bytearray(freq.astype("<u4").tobytes()), rans.SCALE_BITS, rans.LANES, rans.STEP_GAP, int(at))]
    spark.createDataFrame(facts, "freq binary, scale_bits int, lanes int, step_gap int, total long").coalesce(1).write.parquet(out + "/table")

    def code(batches):
        coder = rans.Table(freq)
        for b in batches:
            n = b.column(3).to_numpy()
            part, local = b.column(1).to_numpy(), b.column(2).to_numpy()
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_IDS, side="right")))
                yield _coded(b.slice(at, to - at), n[at:to], part[at:to], local[at:to], coder)
                at = to
        tidy()

    def _coded(b, n, part, local, coder):
        flat = np.frombuffer(b"".join(b.column(4).to_pylist()), width).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(n)])
        first = [0]  # a block begins where the last one is full, or where another run of documents does
        for i in range(1, len(n)):
            if ends[i] - ends[first[-1]] >= block_ids or part[i] != part[i - 1] or local[i] != local[i - 1] + n[i - 1]:
                first.append(i)
        docs_at = np.array([*first, len(n)])
        bounds = ends[docs_at]
        coded = rans.encode(flat, bounds, coder)
        crc = [zlib.crc32(flat[bounds[i] : bounds[i + 1]].astype("<u4")) for i in range(len(first))]
        starts = [base[int(part[i])] + int(local[i]) for i in first]
        offsets = pa.array(docs_at, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int64()), pa.ListArray.from_arrays(offsets, b.column(0)), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())), pa.array([w.tobytes() for w, _ in coded], pa.binary()), pa.array([c.tobytes() for _, c in coded], pa.binary()), pa.array(crc, pa.int64())],
            names=["start", "doc_ids", "doc_lens", "words", "checkpoints", "crc"],
        )

    blocks = ids.mapInArrow(code, f"start long, doc_ids array<{kind}>, doc_lens array<long>, words binary, checkpoints binary, crc long")
    blocks.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(out + "/blocks")
    drop_folder(spark, temp)


def read_stream(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32 bits each) from the files."""
    facts = spark.read.parquet(out + "/table").collect()[0]
    blocks = spark.read.parquet(out + "/blocks")
    freq = np.frombuffer(facts["freq"], "<u4").astype(np.int64)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def back(batches):
        coder = rans.Table(freq, facts["scale_bits"])
        for batch in batches:
            at, weight = 0, np.cumsum([sum(x) for x in batch.column(2).to_pylist()])
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + BATCH_IDS, side="right")))
                yield _decoded(batch.slice(at, to - at), coder)
                at = to
        tidy()

    def _decoded(b, coder):
        lens = b.column(2).to_pylist()
        pairs = [(np.frombuffer(w, "<u4"), np.frombuffer(c, "<u8").reshape(-1, rans.LANES + 1)) for w, c in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        got = rans.decode(pairs, np.array([sum(x) for x in lens]), coder)
        ids, starts, n, crc, raw = [], [], [], [], []
        for i, row in enumerate(got):
            row = row.astype("<u4")
            if zlib.crc32(row) != b.column(5)[i].as_py():
                raise ValueError(f"the block at {b.column(0)[i]} does not match its checksum")
            at, begin = 0, b.column(0)[i].as_py()
            for doc, k in zip(b.column(1)[i].as_py(), lens[i], strict=True):
                piece = row[at : at + k]
                ids.append(doc)
                starts.append(begin + at)
                n.append(k)
                crc.append(zlib.crc32(piece))
                if with_ids:
                    raw.append(piece.tobytes())
                at += k
        columns = [pa.array(ids), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(raw, pa.binary())] if with_ids else [])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return blocks.mapInArrow(back, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_tokenstream(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents written as a token stream and read back."""
    return stream_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stream_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a new folder of the shared storage and return what the files hold."""
    spark = docs.sparkSession
    out = new_folder(spark, "stream")
    write_stream(docs, out, tokenizer or default_tokenizer())
    return read_stream(spark, out)
