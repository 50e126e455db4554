"""Adaptive context-mixing range coder for token ids.

A block is cut into lanes of equal length. Step t codes the t-th id of every lane, all lanes
with one shared model, and then updates the model, so numpy works on whole steps and the
decoder can follow. The model mixes three predictions of an id:

* order 2: the id last seen after the two ids before it, with a confidence from 0 to 15;
* order 1: the same after one id;
* order 0: smoothed counts of all ids so far.

The two confidences pick a cell of an adaptive table that holds how often either prediction
held; the cell's shares are the mixing weights. The mixed distribution drives a range coder
with 32-bit words. A block starts from an empty model and carries crc32 sums of its payload
and of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMX1"
HEADER = struct.Struct("<4sIIIIII")
#: Resolution of the order-0 prediction, and the most weight of one prediction against it.
UNIT = 1 << 20
MOST = 1 << 26
#: Ids must be below this.
ID_LIMIT = 1 << 19
LANES = 4096
SLOT_BITS = 20
#: Change of a confidence from 0 to 15 after a miss, then after a hit.
STEPS = np.array([-((c + 1) >> 1) for c in range(16)] + [1] * 15 + [0], np.int32)
_U64 = np.uint64
_WORD = _U64(32)
_LOW = _U64(0xFFFFFFFF)
_SMALL = _U64(1 << 32)


class _Model:
    """Tables hold a guessed id and its confidence as ``guess << 4 | confidence``."""

    def __init__(self, alphabet: int, expected: int):
        self.alphabet = alphabet
        self.count = np.zeros(alphabet, np.int64)
        self.pending: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self.next = self.steps = 0
        self.shift = np.uint32(32 - min(SLOT_BITS, max(8, int(expected).bit_length())))
        self.table1 = np.zeros(alphabet, np.int32)
        self.table2 = np.zeros(1 << (32 - int(self.shift)), np.int32)
        # Per cell: neither prediction held, the first alone, the second.
        self.held = np.tile([1.6, 0.2, 0.2], (512, 1))
        self.lookup = None

    def refresh(self, lookup: bool) -> None:
        """Order-0 table and weights: at every power of two up to 16 steps, then every 16."""
        if self.steps < self.next:
            return
        self.next = self.steps + max(1, min(16, self.steps))
        if self.pending:
            self.count += np.bincount(np.concatenate(self.pending), minlength=self.alphabet)
            self.held += np.bincount(np.concatenate(self.outcomes), minlength=1536).reshape(512, 3)
            self.pending, self.outcomes = [], []
        total = np.concatenate([[0], np.cumsum(self.count * 32 + 1)])
        cum = np.arange(self.alphabet + 1) + total * (UNIT - self.alphabet) // total[-1]
        self.spans = (cum[:-1] << 21) | np.diff(cum)
        rest = np.maximum(self.held[:, 0], 0.01 * self.held.sum(axis=1))
        w1, w2 = np.minimum(self.held[:, 1:].T / rest * UNIT, MOST).astype(np.int64)
        w1[1::2] = 0  # equal predictions: the second holds all
        self.pairs = (w2 << 27) | w1
        if lookup:
            self.lookup = np.repeat(np.arange(self.alphabet, dtype=np.int32), np.diff(cum))

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of ids in the order-0 prediction."""
        s = self.spans.take(ids)
        return s >> 21, s & 0x1FFFFF

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """Predictions and their weights after the ids ``one`` and, before it, ``two``."""
        self.at1 = one
        key = one.view(np.uint32) * np.uint32(2246822519) ^ two.view(np.uint32) * np.uint32(2654435761)
        key ^= key >> np.uint32(15)
        self.at2 = (key * np.uint32(2654435769)) >> self.shift
        self.e1, self.e2 = self.table1.take(one), self.table2.take(self.at2)
        self.p1, self.p2 = self.e1 >> 4, self.e2 >> 4
        self.c1, self.c2 = self.e1 & 15, self.e2 & 15
        self.cell = (self.c2 << 5) | (self.c1 << 1) | (self.p1 == self.p2)
        w = self.pairs.take(self.cell)
        self.w1, self.w2 = w & 0x7FFFFFF, w >> 27

    def update(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        outcome = self.cell * 3
        outcome += np.maximum(hit1.view(np.uint8), hit2.view(np.uint8) << 1)
        self.outcomes.append(outcome)
        fresh = ids << 4
        for table, at, e, c, hit in (
            (self.table1, self.at1, self.e1, self.c1, hit1), (self.table2, self.at2, self.e2, self.c2, hit2),
        ):
            case = c | hit.view(np.uint8) << 4
            e = e + STEPS.take(case)
            new = np.flatnonzero(case == 0)
            e[new] = fresh[new]
            table[at] = e
        self.pending.append(ids)
        self.steps += 1


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 256))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray) -> bytes:
    """One block; any number of ids from 0 to ``ID_LIMIT`` - 1."""
    n = len(ids)
    if n and (int(ids.min()) < 0 or int(ids.max()) >= ID_LIMIT):
        raise ValueError(f"ids must be from 0 to {ID_LIMIT - 1}")
    sum_ids = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    alphabet = int(ids.max()) + 1 if n else 1
    lanes, steps = _shape(n) if n else (1, 0)
    grid = np.zeros((lanes, steps), np.int32)
    grid.reshape(-1)[:n] = ids
    grid = np.ascontiguousarray(grid.T)
    model = _Model(alphabet, n)
    low, width = np.zeros(lanes, _U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U64)
    words, used, lane = np.zeros((lanes, steps + 2), _U64), np.zeros(lanes, np.int64), np.arange(lanes)
    one = two = np.zeros(lanes, np.int32)
    for x in grid:
        model.refresh(False)
        model.predict(one, two)
        p1, p2, w1, w2 = model.p1, model.p2, model.w1, model.w2
        hit1, hit2 = p1 == x, p2 == x
        begin, size = model.span(x)
        size += w1 * hit1
        size += w2 * hit2
        begin += w1 * (p1 < x)
        begin += w2 * (p2 < x)
        part = width // (UNIT + w1 + w2).view(_U64)
        before = low
        low = low + part * begin.view(_U64)
        if (low < before).any():
            over = np.flatnonzero(low < before)
            words[over, used[over] - 1] += _U64(1)
        width = part * size.view(_U64)
        out = np.flatnonzero(width < _SMALL)
        words[out, used[out]] = low[out] >> _WORD
        used[out] += 1
        low[out] <<= _WORD
        width[out] <<= _WORD
        model.update(x, hit1, hit2)
        one, two = x, one
    last = low + _LOW
    over = np.flatnonzero(last < low)
    words[over, used[over] - 1] += _U64(1)
    words[lane, used] = last >> _WORD
    used += 1
    while (words > _LOW).any():
        carry = words >> _WORD
        words &= _LOW
        words[:, :-1] += carry[:, 1:]
    data = words[np.arange(words.shape[1]) < used[:, None]].astype("<u4").tobytes()
    body = used.astype("<u4").tobytes() + data
    return HEADER.pack(MAGIC, n, lanes, steps, alphabet, sum_ids, zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if a checksum differs."""
    magic, n, lanes, steps, alphabet, sum_ids, sum_body = HEADER.unpack_from(block)
    body = block[HEADER.size:]
    if magic != MAGIC or zlib.crc32(body) != sum_body:
        raise ValueError("damaged block")
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u4", offset=4 * lanes).astype(_U64), np.zeros(1, _U64)])
    stop = np.cumsum(used)
    at = stop - used

    def read(which: np.ndarray) -> np.ndarray:
        got = words[np.where(at[which] < stop[which], at[which], len(words) - 1)]
        at[which] += 1
        return got

    every = np.arange(lanes)
    code = read(every) << _WORD
    code |= read(every)
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U64)
    model = _Model(alphabet, n)
    grid = np.zeros((steps, lanes), np.int32)
    one = two = np.zeros(lanes, np.int32)
    for t in range(steps):
        model.refresh(True)
        model.predict(one, two)
        p1, p2, w1, w2 = model.p1, model.p2, model.w1, model.w2
        total = w1 + w2
        total += UNIT
        part = width // total.view(_U64)
        v = (code // part).view(np.int64)
        total -= 1
        np.minimum(v, total, out=v)
        # Where both predicted ids lie, and how far the point is behind their begins. Equal
        # predictions: the first has no weight, the second holds.
        begin1, size1 = model.span(p1)
        begin2, size2 = model.span(p2)
        begin1 += w2 * (p2 < p1)
        begin2 += w1 * (p1 < p2)
        size1 += w1
        size2 += w2
        v1, v2 = v - begin1, v - begin2
        # A point before the begin is a large number without sign.
        in1, hit2 = v1.view(_U64) < size1.view(_U64), v2.view(_U64) < size2.view(_U64)
        begin, size, x = np.where(hit2, begin2, begin1), np.where(hit2, size2, size1), np.where(hit2, p2, p1)
        # Neither: take out the weights that end before the point.
        miss = np.flatnonzero(~(in1 | hit2))
        past = w1[miss] * (v1[miss] >= size1[miss])
        past += w2[miss] * (v2[miss] >= size2[miss])
        other = model.lookup.take(v[miss] - past)
        x[miss] = other
        begin[miss], size[miss] = model.span(other)
        begin[miss] += past
        hit1 = p1 == x
        code = code - part * begin.view(_U64)
        width = part * size.view(_U64)
        out = np.flatnonzero(width < _SMALL)
        code[out] = (code[out] << _WORD) | read(out)
        width[out] <<= _WORD
        model.update(x, hit1, hit2)
        grid[t] = x
        one, two = x, one
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != sum_ids:
        raise ValueError("damaged block")
    return ids
