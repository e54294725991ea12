"""Static range asymmetric numeral system (rANS) for token ids, vectorised over blocks and lanes.

A block of ids is dealt to `LANES` interleaved coder states: lane k codes ids k, k + LANES, and so on.
States live in [2^32, 2^64) and move 32-bit words; frequencies come from one table shared by all
blocks and sum to 2^SCALE_BITS.  Every `STEP_GAP` steps the encoder records all states and the place
in the word stream; such a checkpoint is where a decoder may begin, so that pieces of one block decode
side by side.  numpy works on all blocks of a batch (encoding) or all pieces (decoding) at once.
"""

from __future__ import annotations

import numpy as np

LANES = 32
STEP_GAP = 256
SCALE_BITS = 20
U64, U32 = np.uint64, np.uint32
LOW = 1 << 32


class Table:
    """Frequencies scaled to 2^bits with at least 1 for each id that occurs, and what follows from them."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        assert int(freq.sum()) == 1 << bits
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        """The id at each of the 2^bits slots."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts of ids as frequencies that sum to 2^bits; id 0 always gets a place (padding uses it)."""
    counts = np.asarray(counts, np.float64).copy()
    counts[0] = max(counts[0], 1)
    held = counts > 0
    if held.sum() > 1 << bits:
        raise ValueError(f"{int(held.sum())} ids do not fit in {bits} bits")
    spare = (1 << bits) - int(held.sum())
    want = counts / counts.sum() * spare
    freq = np.where(held, 1 + np.floor(want), 0).astype(np.int64)
    short = (1 << bits) - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), -(want - np.floor(want)) * held))[:short]
    freq[order] += 1
    return freq


def encode(ids: np.ndarray, bounds: np.ndarray, table: Table):
    """Encode blocks ids[bounds[i]:bounds[i+1]]; a list of (words, checkpoints) per block.

    words: uint32 in reading order.  checkpoints: uint64 [piece, LANES + 1], the states with which
    piece's decoding begins and, last, its place in words.
    """
    n = np.diff(bounds)
    steps = -(-n // LANES)
    order = np.argsort(-steps, kind="stable")
    most = int(steps.max(initial=0))
    grid = np.zeros((len(n), most, LANES), np.uint32)
    for row, b in enumerate(order):
        grid[row].reshape(-1)[: n[b]] = ids[bounds[b] : bounds[b + 1]]
    live = np.searchsorted(-steps[order], -np.arange(most), side="left")  # blocks with more than t steps
    state = np.full((len(n), LANES), U64(LOW))
    out = np.zeros((len(n), most, LANES), np.uint32)
    moved = np.zeros((len(n), most, LANES), bool)
    pieces = -(-most // STEP_GAP)
    marks = np.zeros((len(n), pieces, LANES), np.uint64)
    limit_shift, bits = U64(64 - table.bits), U64(table.bits)
    for t in range(most - 1, -1, -1):
        k = int(live[t])
        x = state[:k]
        s = grid[:k, t]
        f = table.freq[s]
        # f < 2^bits, so the shift cannot overflow unless one id fills the table; then nothing moves
        over = (x >> limit_shift) >= f
        out[:k, t] = x.astype(np.uint32)
        moved[:k, t] = over
        x = np.where(over, x >> U64(32), x)
        q = x // f
        state[:k] = (q << bits) + (x - q * f) + table.start[s]
        if t % STEP_GAP == 0:
            marks[:k, t // STEP_GAP] = state[:k]
    result: list = [None] * len(n)
    for row, b in enumerate(order):
        m = moved[row, : steps[b]]
        per_step = np.concatenate([[0], np.cumsum(m.sum(1))])
        count = -(-int(steps[b]) // STEP_GAP)
        check = np.empty((count, LANES + 1), np.uint64)
        check[:, :LANES] = marks[row, :count]
        check[:, LANES] = per_step[np.arange(count) * STEP_GAP]
        result[b] = (out[row, : steps[b]][m], check)
    return result


def decode(blocks: list, lengths: np.ndarray, table: Table) -> list[np.ndarray]:
    """The ids of each block from its (words, checkpoints); all pieces advance together."""
    lengths = np.asarray(lengths, np.int64)
    steps = -(-lengths // LANES)
    which = np.repeat(np.arange(len(blocks)), [len(c) for _, c in blocks])
    if not len(which):
        return [np.zeros(0, np.uint32) for _ in blocks]
    piece = np.concatenate([np.arange(len(c)) for _, c in blocks])
    base = np.concatenate([[0], np.cumsum([len(w) for w, _ in blocks])])
    words = np.concatenate([*(w for w, _ in blocks), np.zeros(LANES, np.uint32)]).astype(np.uint64)
    check = np.concatenate([c for _, c in blocks])
    todo = np.minimum(STEP_GAP, steps[which] - piece * STEP_GAP)
    order = np.argsort(-todo, kind="stable")
    state = check[order, :LANES].copy()
    at = base[which[order]] + check[order, LANES].astype(np.int64)
    live = np.searchsorted(-todo[order], -np.arange(STEP_GAP), side="left")
    out = np.zeros((len(order), STEP_GAP, LANES), np.uint32)
    mask, bits = U64((1 << table.bits) - 1), U64(table.bits)
    symbol = table.symbol
    for t in range(int(todo.max())):
        k = int(live[t])
        x = state[:k]
        slot = x & mask
        s = symbol[slot]
        out[:k, t] = s
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        low = x < U64(LOW)
        took = np.cumsum(low, axis=1)
        nxt = words[at[:k, None] + took - 1 + (~low)]  # where nothing is read, any word in range will do
        state[:k] = np.where(low, (x << U64(32)) | nxt, x)
        at[:k] += took[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    first = np.concatenate([[0], np.cumsum(-(-steps // STEP_GAP))])
    result = []
    for b in range(len(blocks)):
        rows = back[first[b] : first[b + 1]]
        result.append(out[rows].reshape(-1)[: lengths[b]])
    return result
