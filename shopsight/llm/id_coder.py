"""Context-mixing range coder for token ids, in numpy.

A block is cut into lanes that are coded in step, so every operation works on thousands of ids at once.
Each id is coded in the range of the mixed model: the point predictions of an order-2 and an order-1 context
table come first, what they leave is shared out by an adaptive order-0 distribution over all ids. The weights
of the three are adaptive hit rates by the confidence of both predictions. Encoder and decoder run the same
whole-number model; all lanes of a block share it, and every block starts anew. The order-0 distribution and
the weights are renewed after 1, 2, 4, 8 and every 16 steps, the context tables after every step.

Carries of the encoder are added up at the end, so it keeps only the low end and the width of each lane's range.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
_HEAD = "<4sIIIIII"  # magic, ids, lanes, vocabulary, words, crc32 of ids, crc32 of the coded words
_SLOTS = 18
_TOP, _LOW32 = 1 << 32, (1 << 32) - 1
_FULL = (1 << 48) - 1
_RENEW = 16
_CONFIDENCE = np.arange(8)
#: What is added to an entry (predicted id << 3 | confidence), by confidence: after a miss, and after a hit.
_STEP = np.concatenate([(_CONFIDENCE >> 1) - _CONFIDENCE, np.minimum(_CONFIDENCE + 1, 7) - _CONFIDENCE])


class Model:
    def __init__(self, vocabulary: int, lanes: int, reads: bool):
        self.vocabulary, self.reads = vocabulary, reads
        self.zero_bits = max(20, vocabulary.bit_length() + 4)
        self.bits = self.zero_bits + 4
        self.counts = np.zeros(vocabulary, np.int64)
        self.one, self.two = np.zeros(vocabulary, np.int64), np.zeros(1 << _SLOTS, np.int64)
        self.seen, self.hit1, self.hit2 = (np.full(128, v, np.int64) for v in (64, 8, 16))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.told = 0, []
        self._renew()

    def _renew(self) -> None:
        """Take what the steps since the last renewal have shown into the distribution and the weights."""
        if self.told:
            ids, outcomes = (np.concatenate(x) for x in zip(*self.told))
            self.told = []
            self.counts += np.bincount(ids, minlength=self.vocabulary)
            seen = np.bincount(outcomes, minlength=512).reshape(128, 4)  # by state: miss, order 1, order 2, both
            self.seen += seen.sum(axis=1)
            self.hit1 += seen[:, 1]
            self.hit2 += seen[:, 2] + seen[:, 3]
            old = self.seen > 1 << 18
            for table in (self.seen, self.hit1, self.hit2):
                table[old] >>= 1
        free = (1 << self.zero_bits) - self.vocabulary
        sizes = 1 + self.counts * free // max(int(self.counts.sum()), 1)
        sizes[-1] += (1 << self.zero_bits) - int(sizes.sum())
        self.cum = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(sizes, out=self.cum[1:])
        if self.reads:
            self.owner = np.repeat(np.arange(self.vocabulary, dtype=np.int32), sizes)
        weight = ((1 << self.bits) - (1 << self.zero_bits)) // (self.seen + 1)
        agree = np.arange(128) & 1
        self.to2 = weight * self.hit2
        self.to1 = self.to2 + weight * self.hit1 * (1 - agree)

    def predict(self, lanes: int) -> None:
        self.at1 = self.last[:lanes]
        self.at2 = ((self.before[:lanes] + self.at1 * 0x85EBCA77) >> 9) & ((1 << _SLOTS) - 1)
        self.e1, self.e2 = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3
        self.k1, self.k2 = self.e1 & 7, self.e2 & 7
        self.state = (self.k2 << 4) | (self.k1 << 1) | (self.c1 == self.c2)
        self.m2, self.m1 = self.to2.take(self.state, mode="clip"), self.to1.take(self.state, mode="clip")

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids' ranges, of 1 << bits."""
        self.is1, self.is2 = self.c1 == ids, self.c2 == ids
        rest = (1 << self.bits) - self.m1
        begin = self.m1 + (rest * self.cum.take(ids, mode="clip") >> self.zero_bits)
        end = self.m1 + (rest * self.cum.take(ids + 1, mode="clip") >> self.zero_bits)
        begin, end = np.where(self.is1, self.m2, begin), np.where(self.is1, self.m1, end)
        begin, end = np.where(self.is2, 0, begin), np.where(self.is2, self.m2, end)
        return begin, end - begin

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose ranges hold the values. Quotients are below 2 ** 48 and so exact as floats."""
        rest = (1 << self.bits) - self.m1
        share = (np.maximum(value - self.m1, 0) + 1 << self.zero_bits) - 1
        ids = self.owner.take((share / rest).astype(np.int64))
        ids = np.where(value < self.m1, self.c1, ids)
        return np.where(value < self.m2, self.c2, ids)

    def update(self, ids: np.ndarray) -> None:
        self.told.append((ids, (self.state << 2) | (self.is2 << 1) | self.is1))
        for table, at, entry, k, hit in ((self.one, self.at1, self.e1, self.k1, self.is1),
                                         (self.two, self.at2, self.e2, self.k2, self.is2)):
            new = entry + _STEP.take((hit << 3) | k, mode="clip")
            table[at] = np.where((k == 0) & ~hit, ids << 3, new)
        n = len(ids)
        self.before[:n] = self.last[:n] * 0x9E3779B1
        self.last[:n] = ids
        self.step += 1
        if self.step % _RENEW == 0 or self.step & (self.step - 1) == 0:
            self._renew()


def _shape(n: int, lanes: int) -> tuple[int, int]:
    steps = max(1, -(-n // lanes))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocabulary: int, lanes: int = 4096) -> bytes:
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    if n == 0:
        return struct.pack(_HEAD, MAGIC, 0, 0, vocabulary, 0, checksum, 0)
    lanes, steps = _shape(n, min(lanes, max(1, n // 64)))
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary, lanes, reads=False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
    lane_list, word_list = [], []
    for t in range(steps):
        active = lanes if (lanes - 1) * steps + t < n else lanes - 1
        one = grid[t, :active]
        model.predict(active)
        begin, size = model.interval(one)
        unit = span[:active] >> model.bits
        low[:active] += unit * begin
        span[:active] = unit * size
        model.update(one)
        due = np.flatnonzero(span[:active] < _TOP)
        while len(due):
            at, width = low[due], span[due] << 16
            lane_list.append(due.astype(np.uint32))
            word_list.append((at >> 32).astype(np.int32))  # 17 bits: the top one is carried below
            low[due] = (at & _LOW32) << 16
            span[due] = width
            due = due[width < _TOP]
    inside = (low + 0xFFFF) >> 16  # 32 bits fix a point of the range, whatever words follow
    for words in (inside >> 16, inside & 0xFFFF):
        lane_list.append(np.arange(lanes, dtype=np.uint32))
        word_list.append(words.astype(np.int32))
    lane, word = np.concatenate(lane_list), np.concatenate(word_list)
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    word = word[order]
    while (carry := word >> 16).any():  # the first word of a lane never carries
        word &= 0xFFFF
        word[:-1] += carry[1:]
    counts = np.bincount(lane, minlength=lanes).astype("<u4").tobytes()
    body = counts + word.astype("<u2").tobytes()
    return struct.pack(_HEAD, MAGIC, n, lanes, vocabulary, len(word), checksum, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if either checksum fails."""
    magic, n, lanes, vocabulary, n_words, checksum, body_sum = struct.unpack_from(_HEAD, block)
    body = memoryview(block)[struct.calcsize(_HEAD):struct.calcsize(_HEAD) + 4 * lanes + 2 * n_words]
    if magic != MAGIC or (n and zlib.crc32(body) != body_sum):
        raise ValueError("not a block, or a damaged one")
    if n == 0:
        return np.zeros(0, np.int64)
    steps = _shape(n, lanes)[1]
    counts = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", n_words, 4 * lanes), np.zeros(4, np.uint16)])
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first, second, third = (words[at + k].astype(np.int64) for k in range(3))
    point = first << 32 | second << 16 | third  # from the low end of the range
    at += 3
    model = Model(vocabulary, lanes, reads=True)
    span = np.full(lanes, _FULL, np.int64)
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        active = lanes if (lanes - 1) * steps + t < n else lanes - 1
        model.predict(active)
        unit = span[:active] >> model.bits
        value = np.minimum((point[:active] / unit).astype(np.int64), (1 << model.bits) - 1)
        one = model.find(value)
        begin, size = model.interval(one)
        point[:active] -= unit * begin
        span[:active] = unit * size
        grid[t, :active] = one
        model.update(one)
        due = np.flatnonzero(span[:active] < _TOP)
        while len(due):
            width, place = span[due] << 16, at[due]
            point[due] = (point[due] << 16) | words[place]
            at[due] = place + 1
            span[due] = width
            due = due[width < _TOP]
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block's ids don't match their checksum")
    return ids
