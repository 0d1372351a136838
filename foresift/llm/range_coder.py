"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Every block starts from the same fresh state. Orders 2 and 1 each predict one id from the last two ids or the last one, with
a probability learned for each level of confidence; a learned weight mixes the two. What they leave goes to order 0: learned
frequencies of buckets that hold the id last seen there, and an escape to the plain id. The mixed distribution drives a
64-bit range coder that writes 16-bit words. All blocks of a file advance together, one id at a time, so that each step is a
few array operations over the blocks; a block can still be decoded alone.
"""
from __future__ import annotations

import numpy as np

BLOCK = 2048                    # ids in a block
S2, S1 = 2048, 1024             # contexts of orders 2 and 1 in a block
BUCKETS, SLOT_BITS = 512, 11
SLOTS = 1 << SLOT_BITS
ESCAPE = 64                     # least slots of the escape
REFRESH = frozenset((16, 48, 112, 240, 496, 880, 1392))         # ids after which order 0 takes up its counts
SHIFT = 16 + SLOT_BITS
ID = (1 << 28) - 1
_U = np.uint64
_TOP, _WORD = _U(48), _U(16)
_LOW_RANGE = _U(1 << 48)


class Mixer:
    """The model of n blocks that advance together; only the first `live` ones count."""

    def __init__(self, n: int, decode: bool):
        self.decode = decode
        lane = np.arange(n, dtype=np.int64)
        self.b2, self.b1, self.b8 = lane * S2, lane * S1, lane * 8
        self.b0, self.bc, self.bs = lane * BUCKETS, lane * (BUCKETS + 1), lane * SLOTS
        self.t2, self.t1 = np.zeros(n * S2, np.int64), np.zeros(n * S1, np.int64)
        start = np.array([0, 12000, 24000, 34000, 42000, 48000, 54000, 60000], np.int64)
        self.p2, self.p1 = np.tile(start, n), np.tile(start // 2, n)
        self.w = np.full(n, 40000, np.int64)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.count = np.zeros((n, BUCKETS), np.uint16)
        self.seen = np.zeros(n * BUCKETS, np.int64)             # id + 1 in each bucket
        self.cum = np.zeros((n, BUCKETS + 1), np.int32)
        self.slot = np.full(n * SLOTS, BUCKETS, np.uint16)
        self.t = 0

    def predict(self, live: int):
        last, before = self.last[:live], self.before[:live]
        self.k2 = self.b2[:live] + ((last * 0x9E3B + before * 0x85EB51) >> 5 & (S2 - 1))
        self.k1 = self.b1[:live] + (last * 0x9E3B >> 4 & (S1 - 1))
        e2, e1 = self.t2.take(self.k2), self.t1.take(self.k1)
        self.e2, self.e1 = e2, e1
        self.c2, self.c1 = e2 & ID, e1 & ID
        self.f2, self.f1 = e2 >> 28, e1 >> 28
        self.i2, self.i1 = self.b8[:live] + self.f2, self.b8[:live] + self.f1
        self.q2, self.q1 = self.p2.take(self.i2), self.p1.take(self.i1)
        w = self.w[:live]
        self.m2 = self.q2 * w >> 16
        self.m1 = self.q1 * (65536 - w) >> 16
        self.rest = 65536 - self.m2 - self.m1

    def bucket(self, ids):
        return ids * 40503 >> 5 & (BUCKETS - 1)

    def update(self, ids, bucket, live: int):
        h2, h1 = (self.c2 == ids) & (self.f2 > 0), (self.c1 == ids) & (self.f1 > 0)
        step = 1 << 28
        for table, key, e, f, h in ((self.t2, self.k2, self.e2, self.f2, h2), (self.t1, self.k1, self.e1, self.f1, h1)):
            table[key] = np.where(h, e + (f < 7) * step, np.where(f > 1, (f >> 1) * step + (e & ID), ids + step))
        for p, i, q, f, h in ((self.p2, self.i2, self.q2, self.f2, h2), (self.p1, self.i1, self.q1, self.f1, h1)):
            p[i] = np.maximum(q + (h * 65536 - q >> 5), 64) * (f > 0)
        w = self.w[:live]
        turn = h2.astype(np.int64) - h1
        self.w[:live] = np.clip(w + turn * (np.where(turn > 0, 65536 - w, w) >> 5), 2048, 63488)
        at = self.b0[:live] + bucket
        self.seen[at] = ids + 1
        self.count.reshape(-1)[at] += 1
        self.before[:live] = self.last[:live]
        self.last[:live] = ids
        self.t += 1
        if self.t in REFRESH:
            self._refresh()

    def _refresh(self):
        used = self.count > 0
        room = SLOTS - ESCAPE - used.sum(axis=1, dtype=np.int32)
        freq = (self.count.astype(np.int32) * room[:, None]) // max(self.t, 1) + used
        np.cumsum(freq, axis=1, out=self.cum[:, 1:])
        if self.decode:
            each = np.concatenate([freq, SLOTS - self.cum[:, -1:]], axis=1)
            names = np.tile(np.arange(BUCKETS + 1, dtype=np.uint16), len(freq))
            self.slot = np.repeat(names, each.ravel())

    def interval0(self, bucket, live: int):
        """Order-0 interval of each bucket."""
        at = self.bc[:live] + bucket
        flat = self.cum.reshape(-1)
        low = flat.take(at).astype(np.int64)
        high = flat.take(at + 1).astype(np.int64)
        return low, high - low

    def escape0(self, live: int):
        low = self.cum[:live, -1].astype(np.int64)
        return low, SLOTS - low


def _lanes(n_ids: int) -> tuple[int, int]:
    """Number of blocks and length of the last."""
    blocks = -(-n_ids // BLOCK)
    return blocks, n_ids - (blocks - 1) * BLOCK if blocks else 0


def encode(ids: np.ndarray, id_bits: int) -> list[bytes]:
    """The coded bytes of each block of BLOCK ids."""
    blocks, last = _lanes(len(ids))
    if not blocks:
        return []
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    model = Mixer(blocks, False)
    low, rng = np.zeros(blocks, np.uint64), np.full(blocks, 2**64 - 1, np.uint64)
    width = BLOCK + 64
    out, pos = np.zeros((blocks, width), np.uint32), np.zeros(blocks, np.int64)

    def settle(lanes):
        nonlocal out
        while True:
            need = lanes[rng[lanes] < _LOW_RANGE]
            if not len(need):
                return
            at = pos[need]
            if at.max() >= out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            out[need, at] = (low[need] >> _TOP).astype(np.uint32)
            pos[need] = at + 1
            low[need] <<= _WORD
            rng[need] <<= _WORD

    every = np.arange(blocks)
    for t in range(BLOCK):
        live = blocks if t < last else blocks - 1
        if not live:
            break
        sym = grid[t, :live]
        model.predict(live)
        hit2 = (model.c2 == sym) & (model.f2 > 0)
        hit1 = (model.c1 == sym) & (model.f1 > 0)
        bucket = model.bucket(sym)
        low0, freq0 = model.interval0(bucket, live)
        miss = (model.seen.take(model.b0[:live] + bucket) != sym + 1) | (freq0 == 0)
        esc_low, esc_freq = model.escape0(live)
        low0, freq0 = np.where(miss, esc_low, low0), np.where(miss, esc_freq, freq0)
        both = model.m2 + model.m1
        hit = hit2 | hit1
        cum = np.where(hit, np.where(hit2, 0, model.m2) << SLOT_BITS, (both << SLOT_BITS) + model.rest * low0)
        freq = np.where(hit, (model.m2 * hit2 + model.m1 * hit1) << SLOT_BITS, model.rest * freq0)
        r = rng[:live] >> _U(SHIFT)
        was = low[:live]
        now = was + r * cum.astype(np.uint64)
        _carry(out, pos, np.flatnonzero(now < was))
        low[:live] = now
        rng[:live] = r * freq.astype(np.uint64)
        settle(every[:live])
        raw = np.flatnonzero(miss & ~hit)
        if len(raw):
            r = rng[raw] >> _U(id_bits)
            was = low[raw]
            now = was + r * sym[raw].astype(np.uint64)
            _carry(out, pos, raw[now < was])
            low[raw] = now
            rng[raw] = r
            settle(raw)
        model.update(sym, bucket, live)
    # one more word lies inside the last interval
    ahead = low + _U((1 << 48) - 1)
    _carry(out, pos, np.flatnonzero(ahead < low))
    if pos.max() >= out.shape[1]:
        out = np.concatenate([out, np.zeros((blocks, 1), np.uint32)], axis=1)
    out[every, pos] = (ahead >> _TOP).astype(np.uint32)
    while True:
        rows, cols = np.nonzero(out > 0xFFFF)
        if not len(rows):
            break
        out[rows, cols] -= 0x10000
        np.add.at(out, (rows, cols - 1), 1)
    words = out.astype("<u2")
    return [words[i, :pos[i] + 1].tobytes() for i in range(blocks)]


def _carry(out, pos, lanes):
    if len(lanes):
        out[lanes, pos[lanes] - 1] += 1


def decode(coded: list[bytes], n_ids: int, id_bits: int) -> np.ndarray:
    """The ids of blocks that hold n_ids in all."""
    blocks, last = _lanes(n_ids)
    if not blocks:
        return np.zeros(0, np.int64)
    width = max(len(c) for c in coded) // 2 + 8
    words = np.zeros((blocks, width), np.uint64)
    for i, c in enumerate(coded):
        words[i, :len(c) // 2] = np.frombuffer(c, "<u2")
    flat = words.reshape(-1)
    value = (words[:, 0] << _U(48)) | (words[:, 1] << _U(32)) | (words[:, 2] << _U(16)) | words[:, 3]
    place = np.arange(blocks, dtype=np.int64) * width + 4
    end = (np.arange(blocks, dtype=np.int64) + 1) * width - 1
    rng = np.full(blocks, 2**64 - 1, np.uint64)
    model = Mixer(blocks, True)
    grid = np.zeros((BLOCK, blocks), np.int64)
    every = np.arange(blocks)

    def settle(lanes):
        while True:
            need = lanes[rng[lanes] < _LOW_RANGE]
            if not len(need):
                return
            at = place[need]
            value[need] = (value[need] << _WORD) | flat.take(np.minimum(at, end[need]))
            place[need] = at + 1
            rng[need] <<= _WORD

    for t in range(BLOCK):
        live = blocks if t < last else blocks - 1
        if not live:
            break
        model.predict(live)
        r = rng[:live] >> _U(SHIFT)
        v = np.minimum(value[:live] // r, _U((1 << SHIFT) - 1)).astype(np.int64)
        both = model.m2 + model.m1
        head = v >> SLOT_BITS
        same = (model.c2 == model.c1) & (model.f2 > 0) & (model.f1 > 0)
        use2 = (head < model.m2) | (same & (head < both))
        use1 = (head < both) & ~use2
        known = use1 | use2
        slot = np.where(known, 0, (v - (both << SLOT_BITS)) // model.rest)
        name = model.slot.take(model.bs[:live] + slot).astype(np.int64)
        miss = name == BUCKETS
        low0, freq0 = model.interval0(np.where(miss, 0, name), live)
        esc_low, esc_freq = model.escape0(live)
        low0, freq0 = np.where(miss, esc_low, low0), np.where(miss, esc_freq, freq0)
        sym = np.where(use2, model.c2, np.where(use1, model.c1,
                       model.seen.take(model.b0[:live] + np.where(miss, 0, name)) - 1))
        mass = np.where(use2, model.m2 + model.m1 * same, model.m1)
        cum = np.where(known, np.where(use2, 0, model.m2) << SLOT_BITS, (both << SLOT_BITS) + model.rest * low0)
        freq = np.where(known, mass << SLOT_BITS, model.rest * freq0)
        value[:live] -= r * cum.astype(np.uint64)
        rng[:live] = r * freq.astype(np.uint64)
        settle(every[:live])
        raw = np.flatnonzero(miss & ~known)
        if len(raw):
            r = rng[raw] >> _U(id_bits)
            plain = np.minimum(value[raw] // r, _U((1 << id_bits) - 1))
            value[raw] -= r * plain
            rng[raw] = r
            settle(raw)
            sym[raw] = plain.astype(np.int64)
        model.update(sym, model.bucket(sym), live)
        grid[t, :live] = sym
    return np.ascontiguousarray(grid.T).reshape(-1)[:n_ids]
