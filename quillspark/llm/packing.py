"""Best-fit packing of documents into token sequences: bin completion over the table of piece lengths.

Documents are tokenized, ended by an id, and cut into pieces of at most `size` ids.  What a packing needs of
them is how many pieces there are of each length, at most `size` numbers whatever the corpus, so the search
runs on that table and its solutions are patterns (the lengths in one sequence) with a number of uses:

* Incumbent: best-fit decreasing, done by counts.  Sequences with equal room left are one class.
* Branching: the longest open piece must go somewhere; its fillings are the undominated sets of shorter
  pieces for the room beside it.  A set is dominated if one of its subsets can be replaced by one open
  piece of at least its size.  A filling is used as often as the counts allow, least waste first.
* Bound: fewer sequences than the incumbent leave a known number of ids of waste; a branch that has spent
  more ends.  After each filling the rest is packed by best fit, and a better packing is the new incumbent.
* The search ends when the incumbent meets the lower bound (total ids, and pieces too long to share), or
  after NODES fillings; then the incumbent stands, a whole packing in any case.

A pattern's uses empty at least one length, so a packing has at most some thousand patterns; as arrays they
go with the tasks that place the pieces.  A piece's place follows from its number among the pieces of its
length: each task numbers its own pieces by length, and a running sum over tasks per length makes the
numbers global.  No length, however frequent, is gathered in a task.

Defined cases: null and empty texts are the end id alone; repeated and null ids are documents of their own; an empty
table gives no rows; very long texts are tokenized whole; ids of any type are kept; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import SPACE, binary_rows, sub_batches, text_buffer, tidy, written
from quillspark.llm.tokenstream import CACHE_BYTES, CACHE_PIECES, LETTER, Tokens

SIZE = 2048
END_ID = 0
TEXT_BYTES = 2 << 20
NODES = 400
FILLINGS, BRANCHES, VISITS = 8, 6, 400
WORD_END = "</w>"
DIGIT, SIGN = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SIGN[0x21:0x7F] = True
SIGN &= ~(LETTER | DIGIT)
KIND = LETTER * np.int8(1) + DIGIT * np.int8(2) + SIGN * np.int8(3)


# --- tokens -------------------------------------------------------------------------------------


class WordTokens(Tokens):
    """A tokenizer that drops white space and splits letters, digits and signs, with a cache of pieces.

    ASCII white space goes first.  A text is cut where it stood, and between ASCII characters that such a
    pre-tokenizer never joins: a letter and what is none, a digit and anything, a sign and a letter; but not
    after an apostrophe, which contractions take, nor at signs that special tokens are written with.  A new
    piece of plain ASCII characters is one word to the model, so such pieces are tokenized in long runs,
    which are cut again after the tokens that end a word.
    """

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(len(self.lengths), bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(WORD_END)
        self.sign = SIGN.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.sign[[x for x in token.content.encode() if SIGN[x]]] = False
        self.plain = LETTER | DIGIT | self.sign
        self.plain[0x27] = False

    @staticmethod
    def of(path: str) -> WordTokens:
        import tokenizers

        known = tokenizers.__dict__.setdefault("_quillspark_words", {})
        if path not in known:
            known[path] = WordTokens(path)
        return known[path]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per row) of the texts in an Arrow buffer, without end ids."""
        solid = ~SPACE[data]
        place = np.concatenate([[0], np.cumsum(solid)])
        offs, border = place[offs], place[np.flatnonzero(~solid)]
        data = data[solid]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        kind = KIND[data] * (self.sign | ~SIGN)[data]
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a > 0) & (b > 0) & ((a != b) | (a == 2)) & (data[:-1] != 0x27)
        cut[border] = cut[offs] = True
        starts = np.flatnonzero(cut[:-1])
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
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
            self._learn([pieces[i] for i in new.tolist()], np.logical_and.reduceat(self.plain[data], starts)[first[new]])
        count = self.count[at][codes]
        done = np.cumsum(count)
        ids = self.pool[np.repeat(self.place[at][codes] - (done - count), count) + np.arange(int(done[-1]))]
        return ids, np.concatenate([[0], done])[np.searchsorted(starts, offs)]

    def _run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of pieces that are one word each."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(texts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", size: int = SIZE) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian), task and its number there among pieces of its length."""
    width = "<u2" if Tokens.of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def run(batches):
        tokens, part, seen = WordTokens.of(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in sub_batches(batches, limit=TEXT_BYTES):
            ids, bounds = tokens.encode(*text_buffer(b.column(1)))
            ids = np.insert(ids, bounds[1:], END_ID)
            n = np.diff(bounds) + 1
            first = np.concatenate([[0], np.cumsum(n)])
            each = -(-n // size)
            row = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            length = np.minimum(size, n[row] - piece * size)
            begin = first[row] + piece * size
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[x:y]) for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, at, count = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(at - seen[kinds], count)
            seen[kinds] += count
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), binary_rows(ids.astype(width), np.append(begin, len(ids))), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"],
            )
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long")


# --- the search ---------------------------------------------------------------------------------
# Counts are lists by length; a pattern is a tuple of (length, times), the longest first; a packing is [(pattern, uses)].


def lower_bound(counts: list[int], size: int = SIZE) -> int:
    """No packing has fewer sequences: total ids, and for each threshold the pieces that can't share with others."""
    lengths = np.arange(size + 1, dtype=object)
    n = np.array(counts, dtype=object)
    upto, ids = np.cumsum(n), np.cumsum(n * lengths)
    best = -(-int(ids[-1]) // size)
    half = size // 2
    for small in range(1, half + 1):
        alone = upto[size] - upto[size - small]
        large = upto[size - small] - upto[half] if size - small > half else 0
        room = large * size - (ids[size - small] - ids[half]) if size - small > half else 0
        rest = ids[min(half, size - small)] - ids[small - 1]
        best = max(best, int(alone + large + max(0, -(-(rest - room) // size))))
    return best


def best_fit(counts: list[int], size: int = SIZE) -> list[tuple[tuple, int]]:
    """Best-fit decreasing by counts: a piece goes where the least room is left that holds it."""
    rooms: dict[int, list] = {}
    bits = 0  # rooms that some sequence has left
    for length in range(size, 0, -1):
        n = counts[length]
        while n:
            fits = bits >> length
            room = length + (fits & -fits).bit_length() - 1 if fits else size
            pattern, held = rooms[room].pop() if fits else ((), n)
            if fits and not rooms[room]:
                bits ^= 1 << room
            times = room // length
            whole = min(held, n // times)
            put = [(times, whole)] if whole else []
            n -= whole * times
            if whole < held and 0 < n < times:
                put.append((n, 1))
                n = 0
            if fits and (left := held - sum(u for _, u in put)):
                rooms[room].append((pattern, left))
                bits |= 1 << room
            for times, uses in put:
                rest = room - times * length
                rooms.setdefault(rest, []).append(((*pattern, (length, times)), uses))
                if rest:
                    bits |= 1 << rest
    return [x for held in rooms.values() for x in held]


def _dominated(parts: list[int], slack: int, counts: list[int], bits: int) -> bool:
    """Whether an open piece can replace a subset (of up to three parts) that it is at least as large as."""
    used = Counter(parts)

    def open_between(low: int, high: int) -> bool:
        at = bits >> low
        while at:
            low += (at & -at).bit_length() - 1
            if low > high:
                return False
            if counts[low] > used[low]:
                return True
            low += 1
            at = bits >> low
        return False

    for k in range(min(3, len(parts)) + 1):
        for some in set(combinations(parts, k)):
            total = sum(some)
            if open_between(total + (k < 2), total + slack):
                return True
    return False


def fillings(counts: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated sets of open pieces for a room, least waste first; at most FILLINGS, from VISITS sets looked at."""
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]  # one piece that fits exactly dominates every other filling
    lengths = [x for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]]
    bits = sum(1 << x for x in lengths)
    found, visits = {}, 0
    stack = [((), room)]
    while stack and visits < VISITS:
        parts, left = stack.pop()
        visits += 1
        top = parts[-1] if parts else room
        used = Counter(parts)
        nexts = []
        for x in lengths:
            if x <= min(left, top) and counts[x] > used[x]:
                nexts.append(x)
                if len(nexts) == BRANCHES:
                    break
        if not nexts:
            if not _dominated(list(parts), left, counts, bits):
                found[parts] = left
            continue
        stack += [((*parts, x), left - x) for x in reversed(nexts)]
    return sorted(found, key=lambda p: (found[p], len(p)))[:FILLINGS] or [()]


def complete(counts: list[int], size: int = SIZE, nodes: int = NODES) -> tuple[list[tuple[tuple, int]], int]:
    """(packing, lower bound): branch and bound over fillings around the longest open piece."""
    least, total = lower_bound(counts, size), sum(x * n for x, n in enumerate(counts))
    best = best_fit(counts, size)
    held = sum(u for _, u in best)
    stack = [(list(counts), [], 0, 0)]
    while stack and held > least and nodes > 0:
        rest, chosen, used, waste = stack.pop()
        longest = next((x for x in range(size, 0, -1) if rest[x]), 0)
        if not longest or waste > (held - 1) * size - total:
            continue
        children = []
        for filling in fillings([*rest[:longest], rest[longest] - 1, *rest[longest + 1 :]], size - longest):
            nodes -= 1
            pattern = tuple(sorted(Counter((longest, *filling)).items(), reverse=True))
            uses = min(rest[x] // k for x, k in pattern)
            more = waste + uses * (size - sum(x * k for x, k in pattern))
            if more > (held - 1) * size - total:
                continue
            after = list(rest)
            for x, k in pattern:
                after[x] -= uses * k
            packing = [*chosen, (pattern, uses)]
            tail = best_fit(after, size)
            n = used + uses + sum(u for _, u in tail)
            if n < held:
                best, held = packing + tail, n
                if held <= least:
                    break
            children.append((after, packing, used + uses, more))
        stack += reversed(children)
    return best, least


class Places:
    """Arrays that give the place of the nth piece of a length; a row for each pattern and length in it."""

    def __init__(self, packing: list[tuple[tuple, int]], counts: list[int]):
        rows, base, done = [], 0, [0] * len(counts)
        for pattern, uses in packing:
            offset = 0
            for length, times in pattern:
                rows.append((length, done[length], times, base, offset))
                done[length] += times * uses
                offset += length * times
            base += uses
        if done != list(counts):
            raise ValueError("the packing does not hold each piece once")
        rows.sort()
        self.length, self.first, self.times, self.base, self.offset = np.array(rows or [(0, 0, 1, 0, 0)], np.int64).T
        self.key = self._key(self.length, self.first)

    @staticmethod
    def _key(length: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return length.astype(np.int64) << 48 | nth

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset)."""
        at = np.searchsorted(self.key, self._key(length, nth), side="right") - 1
        use, which = np.divmod(nth - self.first[at], self.times[at])
        return self.base[at] + use, self.offset[at] + which * length


def placed(pieces: DataFrame, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """pieces (written) with sequence_id and offset in place of task and nth."""
    counts = [0] * (size + 1)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # `size` rows at most
        counts[r["length"]] = r["n"]
    places = Places(complete(counts, size, nodes)[0], counts)
    each = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each task
    before = each.select("length", "task", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    rows = pieces.join(before, ["length", "task"])
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    rows = rows.select(*kept, (F.col("before") + F.col("nth")).alias("_nth"))

    def run(batches):
        for b in batches:
            sequence, offset = places.of(b.column(b.schema.get_field_index("length")).to_numpy(), b.column(len(kept)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.mapInArrow(run, kinds + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text", size: int = SIZE, nodes: int = NODES, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    pieces, _ = written(pieces_of(docs, tokenizer or default_tokenizer(), id_col, text_col, size), "pieces")
    return placed(pieces if with_ids else pieces.drop("ids"), size, nodes)


def sequences(packed: DataFrame) -> DataFrame:
    """packed (with ids) -> a row for each sequence: sequence_id, doc_ids, lengths and ids, in the order of offsets."""
    kind = packed.schema["doc_id"].dataType.simpleString()
    rows = packed.select("sequence_id", F.struct("offset", "doc_id", "length", "ids").alias("x")).groupBy("sequence_id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # `size` pieces at most
    joined = F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", F.col("x.doc_id").cast(f"array<{kind}>").alias("doc_ids"), F.col("x.length").alias("lengths"), joined.alias("ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the place of every piece of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
