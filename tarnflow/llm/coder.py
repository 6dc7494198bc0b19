"""Adaptive context-mixing range coder for blocks of token ids.

A block starts from an empty model and ends with a checksum, so blocks are read alone and in any order. Its ids are
dealt to lanes (consecutive parts of the block), which one model codes side by side, an id of each lane at a time;
after each step the model learns from the ids of all lanes.

The model predicts in three orders: the id that followed the last two ids, the one that followed the last id (each
with a confidence of 0 to 7), and how often ids occurred at all. The mixer gives each order its share of the interval
by how often it was right before in the same class of confidences; the coder then narrows a lane's interval to the
order that is right, and for order 0 to the id's share of the counts. Shares are renewed every few steps.

Block format, little endian: magic "CMR2", u32 ids, u32 lanes, u32 steps, u32 distinct ids, u32 crc32 of the ids as
u32; then the distinct ids in order (u32; inside, an id is its place among them), u32 words of each lane, and the
lanes' u16 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

MAGIC = b"CMR2"
HEAD = struct.Struct("<4sIIIII")
LANES, MOST, REFRESH, REMIX = 8192, 1 << 22, 32, 4
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
MIX_BITS, ID_BITS, SLOTS = np.uint64(12), np.uint64(24), 1 << 16
ONE, WORD, WHOLE = np.uint64(1), np.uint64(16), np.uint64(1 << 24)


class Corrupt(ValueError):
    """A block that isn't what was written."""


class Model:
    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.counts, self.new = np.zeros(vocabulary, np.int64), []
        # A guess and, in the last three bits, its confidence.
        self.order1, self.order2 = np.zeros(vocabulary, np.int32), np.zeros(SLOTS, np.int32)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.seen = np.tile(np.array([2, 2, 4], np.int64), (64, 1))
        self.step = 0

    def _refresh(self) -> None:
        if self.new:
            self.counts += np.bincount(np.concatenate(self.new), minlength=len(self.counts))
            self.new = []
        n, room = int(self.counts.sum()), (1 << int(ID_BITS)) - len(self.counts)
        self.sizes = (1 + self.counts * room // max(1, n)).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.uint64)

    def _remix(self) -> None:
        total = self.seen.sum(axis=1, keepdims=True)
        self.seen = np.where(total > 60000, (self.seen + 1) >> 1, self.seen)
        room = (1 << int(MIX_BITS)) - 3
        parts = 1 + self.seen * room // self.seen.sum(axis=1, keepdims=True)
        parts[:, 2] += (1 << int(MIX_BITS)) - parts.sum(axis=1)
        self.parts = parts.astype(np.uint64)
        self.edges = (np.cumsum(parts, axis=1) - parts).astype(np.uint64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1 of each lane; sets `at`, where the shares of its class of confidences begin."""
        young = self.step & (self.step - 1) == 0
        if young or self.step % REFRESH == 0:
            self._refresh()
        if young or self.step % REMIX == 0:
            self._remix()
        self.slot = (self.before * np.int32(40503) + self.last * np.int32(30011)) & np.int32(SLOTS - 1)
        self.held2, self.held1 = self.order2[self.slot], self.order1[self.last]
        self.at = ((self.held2 & 7) * 8 + (self.held1 & 7)).astype(np.intp) * 3
        return self.held2 >> 3, self.held1 >> 3

    def learn(self, ids: np.ndarray, order: np.ndarray, g2: np.ndarray, g1: np.ndarray) -> None:
        """order: 0 where the guess of order 2 was right, 1 where that of order 1 was, 2 else."""
        self.seen += np.bincount(self.at + order, minlength=192).reshape(64, 3)
        self.new.append(ids)
        for table, at, held, g in ((self.order2, self.slot, self.held2, g2), (self.order1, self.last, self.held1, g1)):
            sure, hit = held & 7, g == ids
            table[at] = np.where(hit | (sure > 1), g, ids) * 8 + np.where(hit, np.minimum(sure + 1, 7), sure >> 1)
        self.before, self.last = self.last, ids
        self.step += 1


class Lanes:
    """The intervals of all lanes. `shift` is told which lanes move on by a word, and the lower ends they had."""

    def __init__(self, lanes: int, shift: Callable[[np.ndarray, np.ndarray], None]) -> None:
        self.low, self.size, self.shift = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64), shift

    def narrow(self, start: np.ndarray, part: np.ndarray, bits: np.uint64) -> None:
        unit = self.size >> bits
        self.low += start * unit
        self.size = part * unit

    def settle(self) -> None:
        low, size = self.low, self.size
        todo = np.flatnonzero(((low ^ (low + size)) < TOP) | (size < BOTTOM))
        while len(todo):
            a, b = low[todo], size[todo]
            b = np.where((a ^ (a + b)) < TOP, b, (~a + ONE) & (BOTTOM - ONE))
            self.shift(todo, a)
            a, b = a << WORD, b << WORD
            low[todo], size[todo] = a, b
            todo = todo[((a ^ (a + b)) < TOP) | (b < BOTTOM)]


def encode(ids: np.ndarray) -> bytes:
    """A block of the ids (unsigned, below 2**23)."""
    n = len(ids)
    lanes = int(np.clip(n // 256, 1, LANES))
    steps = -(-n // lanes)
    known = np.flatnonzero(np.bincount(ids)) if n else np.zeros(1, np.int64)
    vocabulary = len(known)
    place = np.zeros(int(known[-1]) + 1, np.int32)
    place[known] = np.arange(vocabulary)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = place[ids]
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary, lanes)
    words, at = np.zeros((lanes, 4 * steps + 8), np.uint16), np.zeros(lanes, np.int64)

    def shift(todo: np.ndarray, low: np.ndarray) -> None:
        words[todo, at[todo]] = (low >> np.uint64(48)).astype(np.uint16)
        at[todo] += 1

    held = Lanes(lanes, shift)
    for row in grid:
        g2, g1 = model.predict()
        order = np.where(row == g2, 0, np.where(row == g1, 1, 2))
        cell = model.at + order
        held.narrow(model.edges.reshape(-1)[cell], model.parts.reshape(-1)[cell], MIX_BITS)
        plain = order == 2
        held.narrow(np.where(plain, model.starts[row], np.uint64(0)), np.where(plain, model.sizes[row], WHOLE), ID_BITS)
        held.settle()
        model.learn(row, order, g2, g1)
    for bits in (48, 32, 16, 0):
        words[np.arange(lanes), at] = ((held.low >> np.uint64(bits)) & np.uint64(0xFFFF)).astype(np.uint16)
        at += 1
    body = words[np.arange(words.shape[1])[None, :] < at[:, None]].astype("<u2").tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEAD.pack(MAGIC, n, lanes, steps, vocabulary, crc) + known.astype("<u4").tobytes() + at.astype("<u4").tobytes() + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises Corrupt where the checksum or the form doesn't hold."""
    try:
        magic, n, lanes, steps, vocabulary, crc = HEAD.unpack_from(block)
        known = np.frombuffer(block, "<u4", vocabulary, HEAD.size)
        counts = np.frombuffer(block, "<u4", lanes, HEAD.size + 4 * vocabulary).astype(np.int64)
        body = np.frombuffer(block, "<u2", -1, HEAD.size + 4 * (vocabulary + lanes)).astype(np.uint64)
    except (struct.error, ValueError) as e:
        raise Corrupt(str(e)) from e
    if magic != MAGIC or counts.sum() != len(body) or not lanes or not n <= lanes * steps < n + lanes or not 0 < vocabulary <= 1 << 23:
        raise Corrupt("not a block")
    body = np.append(body, np.zeros(8, np.uint64))
    at = np.cumsum(counts) - counts
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << WORD) | body[at]
        at += 1
    last = len(body) - 1
    model = Model(vocabulary, lanes)

    def shift(todo: np.ndarray, low: np.ndarray) -> None:
        code[todo] = (code[todo] << WORD) | body[np.minimum(at[todo], last)]
        at[todo] += 1

    held = Lanes(lanes, shift)
    grid = np.empty((steps, lanes), np.int32)
    for k in range(steps):
        g2, g1 = model.predict()
        away, unit = code - held.low, held.size >> MIX_BITS
        edges = model.edges.reshape(-1)
        order = (away >= edges[model.at + 1] * unit).astype(np.intp) + (away >= edges[model.at + 2] * unit)
        cell = model.at + order
        held.narrow(edges[cell], model.parts.reshape(-1)[cell], MIX_BITS)
        row = np.where(order == 0, g2, g1)
        plain = np.flatnonzero(order == 2)
        point = (code[plain] - held.low[plain]) // np.maximum(held.size[plain] >> ID_BITS, ONE)
        found = np.clip(np.searchsorted(model.starts, point, side="right") - 1, 0, vocabulary - 1)
        row[plain] = found
        start, part = np.zeros(lanes, np.uint64), np.full(lanes, WHOLE)
        start[plain], part[plain] = model.starts[found], model.sizes[found]
        held.narrow(start, part, ID_BITS)
        held.settle()
        model.learn(row, order, g2, g1)
        grid[k] = row
    ids = known[np.ascontiguousarray(grid.T).reshape(-1)[:n]]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise Corrupt("checksum")
    return ids
