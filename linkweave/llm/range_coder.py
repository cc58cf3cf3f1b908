"""An adaptive context-mixing range coder for token ids, in independent blocks.

A block of ids is coded on its own: its models start afresh, and it has a checksum. Its ids are cut into runs, one a lane
of numpy arrays, and all lanes advance together, one id a step. The lanes share the block's models, so what one run has
shown helps all others, and the models stay small enough for a processor's cache.

For each id, order 2 (the two ids before, in checked slots by their hash) predicts one id, and order 1 (the id before)
two, each with a confidence. Which prediction holds is coded first, by shares that mix three estimates: the counts of
what held at both confidences, at that of order 2, and at that of order 1. Where none holds, order 0 codes the id by
the counts of the ids that no prediction had; an id that has not been seen so far takes an escape and its 16 bits.

Predictions are learnt after every step; shares are made anew after steps 1, 2, 4, 8 and every ROUND steps, from counts
that are halved when they are large. All of it is integers, so the decoder repeats exactly what the encoder did.

The coder keeps 64 bits of low and range and puts out 16 at a time; where low and the end of the range still differ
above, the range is cut at the border instead of carrying.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, lanes at most, ids of a lane at least, steps between new shares.
BLOCK, LANES, LEAST, ROUND = 1 << 22, 8192, 128, 32
_IDS, _SLOTS, _SHARE = 1 << 16, 18, 16
_FULL, _FULL_IDS = 1 << 14, 1 << 20
_U = np.uint64
_TOP, _LEAST, _LOW = _U(48), _U(1 << 48), _U((1 << 48) - 1)
_BITS = _U(_SHARE)
#: What held: 0 nothing, 1 order 1's first id, 2 its second, 3 order 2's; by (order 2, first, second) as bits.
_HELD = np.array([0, 3, 1, 3, 2, 3, 1, 3])
#: Confidence of order 1 after a miss or a hit of its first id; one of at most YIELDS gives way to the new id.
_YIELDS = 2
_NEXT = np.array([1, 1, 1, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 7, 7])
#: The same of order 2: another context's slot, its own with a miss, never, its own with a hit.
_NEXT_TWO = np.concatenate([[1, 1, 1, 2, 2, 3, 4, 5], _NEXT[:8], np.zeros(8, np.int64), _NEXT[8:]])
#: Whether order 2's slot is given to the new context and id, by the same states.
_FRESH = np.array([k < 16 and k % 8 <= _YIELDS for k in range(32)]).astype(np.int64)


def _flag(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _either(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where the flag is 1, b where it is 0; without branches, which cost numpy more than the arithmetic."""
    return b ^ ((a ^ b) & -flag)


class _Models:
    def __init__(self):
        self.ones, self.twos = np.zeros(_IDS, np.int64), np.zeros(1 << _SLOTS, np.int64)
        self.joint = np.zeros((8, 16, 4), np.int64)  # by confidence of order 2, of order 1 and whether both say the same
        self.missed = np.zeros(_IDS + 1, np.int64)
        self.missed[_IDS] = 32
        self.held: list[np.ndarray] = []
        self.misses: list[np.ndarray] = []
        self.steps = 0
        self._shares()
        self._missed_shares()

    def _shares(self) -> None:
        """share and below: of each outcome at each pair of confidences."""

        def estimate(counts: np.ndarray) -> np.ndarray:
            return 24 * counts // (counts.sum(axis=-1, keepdims=True) + 1)

        mixed = 4 * self.joint + estimate(self.joint.sum(axis=1, keepdims=True)) + estimate(self.joint.sum(axis=0, keepdims=True)) + 1
        share = mixed * ((1 << _SHARE) - 4) // mixed.sum(axis=-1, keepdims=True) + 1
        share[..., 0] += (1 << _SHARE) - share.sum(axis=-1)
        self.below = np.ascontiguousarray(np.cumsum(share, axis=-1) - share).reshape(-1)
        self.share = share.reshape(-1)

    def _missed_shares(self) -> None:
        """The same of each id that order 0 has seen, and of the escape."""
        seen = self.missed > 0
        total = int(self.missed.sum())
        own = self.missed * ((1 << _SHARE) - int(seen.sum())) // total + seen
        own[_IDS] += (1 << _SHARE) - int(own.sum())
        self.own, self.under = own, np.cumsum(own) - own
        self.found = np.repeat(np.arange(_IDS + 1), own)

    def predict(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The place of each lane's outcomes in share and below."""
        key = last * 0x2F0B4C47 + before * 0x1D8AF067
        self.slot = (key >> 12) & ((1 << _SLOTS) - 1)
        self.check = (key >> 30) << 19
        self.two, self.one, self.last = self.twos[self.slot], self.ones[last], last
        self.same = _flag(((self.two ^ self.check) >> 19) == 0)
        self.sure = (self.two >> 16) & 7
        self.says = (self.two & 0xFFFF, self.one & 0xFFFF, (self.one >> 16) & 0xFFFF)
        self.trust = self.one >> 32
        return ((self.sure & -self.same) << 6) | (self.trust << 3) | (_flag(self.says[0] == self.says[1]) << 2)

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        two, first, second = ((s == ids).view(np.int8) for s in self.says)
        return _HELD[two + (first << 1) + (second << 2)]

    def learn(self, ids: np.ndarray, held: np.ndarray, missed: np.ndarray) -> None:
        """ids of a step, the place of what held in share, the ids that no prediction had."""
        right, old = _flag(self.says[0] == ids), self.two & ~(7 << 16)
        state = self.sure | (self.same << 3) | ((right & self.same) << 4)
        self.twos[self.slot] = _either(_FRESH[state], self.check | ids, old) | (_NEXT_TWO[state] << 16)
        right = _flag(self.says[1] == ids)
        keep = right | (self.trust > _YIELDS)
        second = _either(right, self.says[2], _either(keep, ids, self.says[1]))
        self.ones[self.last] = _either(keep, self.says[1], ids) | (second << 16) | (_NEXT[self.trust | (right << 3)] << 32)
        self.held.append(held)
        self.misses.append(missed)
        self.steps += 1
        if self.steps % ROUND == 0 or self.steps in (1, 2, 4, 8):
            self.joint += np.bincount(np.concatenate(self.held), minlength=512).reshape(self.joint.shape)
            self.missed += np.bincount(np.concatenate(self.misses), minlength=_IDS + 1)
            self.held, self.misses = [], []
            self.joint -= (self.joint >> 1) * (self.joint.sum(axis=-1, keepdims=True) > _FULL)
            if self.missed.sum() > _FULL_IDS:
                self.missed -= self.missed >> 1
            self._shares()
            self._missed_shares()


class _Coder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)

    def narrow(self, on: np.ndarray, part: np.ndarray, below: np.ndarray, own: np.ndarray) -> None:
        self.low[on] += part * below.view(_U)
        self.range[on] = part * own.view(_U)

    def due(self):
        """Lanes that put out 16 bits, again and again until none is due."""
        on = np.flatnonzero(self.range < _LEAST)
        while len(on):
            low, size = self.low[on], self.range[on]
            split = ((low ^ (low + size - _U(1))) >> _TOP) != 0
            rest = low & _LOW
            if split.any():
                size = np.where(split, _LEAST - rest, size)
            if not size.all():  # only what wasn't written by encode() gets here
                raise ValueError("a block is damaged")
            yield on, low >> _TOP
            size <<= _U(16)
            self.low[on], self.range[on] = rest << _U(16), size
            on = on[size < _LEAST]


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and lanes that have an id in the last step."""
    lanes = max(1, min(LANES, n // LEAST))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _to_steps(ids: np.ndarray) -> np.ndarray:
    """Ids by step and lane; the first lanes are one longer than the others where they don't come out even."""
    lanes, steps, full = _lanes(len(ids))
    out = np.zeros((lanes, steps), np.uint16)
    out[:full] = ids[: full * steps].reshape(full, steps)
    out[full:, : steps - 1] = ids[full * steps :].reshape(lanes - full, steps - 1)
    return np.ascontiguousarray(out.T)


def _encode_block(ids: np.ndarray) -> bytes:
    lanes, steps, full = _lanes(len(ids))
    models, coder, rows = _Models(), _Coder(lanes), _to_steps(ids)
    width = 3 * steps + 8
    out, used = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    last = before = np.zeros(lanes, np.int64)
    for t in range(steps):
        x = rows[t].astype(np.int64)
        if t == steps - 1:
            x, last, before = x[:full], last[:full], before[:full]
        place = models.predict(last, before) + models.outcome(x)
        on = slice(0, len(x))
        part = coder.range[on] >> _BITS
        coder.low[on] += part * models.below[place].view(_U)
        coder.range[on] = part * models.share[place].view(_U)
        on = np.flatnonzero((place & 3) == 0)
        missed = x[on]
        own = models.own[missed]
        sign = np.where(own > 0, missed, _IDS)
        coder.narrow(on, coder.range[on] >> _BITS, models.under[sign], models.own[sign])
        on = on[own == 0]
        if len(on):
            new = x[on]
            coder.narrow(on, coder.range[on] >> _BITS, new, np.ones(len(on), np.int64))
        for on, unit in coder.due():
            at = used[on]
            out[at] = unit
            used[on] = at + 1
        models.learn(x, place, missed)
        last, before = x, last
    for _ in range(4):
        out[used] = coder.low >> _TOP
        used += 1
        coder.low <<= _U(16)
    sizes = used - np.arange(lanes) * width
    return sizes.astype("<u4").tobytes() + b"".join([out[k * width : k * width + n].astype("<u2").tobytes() for k, n in enumerate(sizes.tolist())])


def _decode_block(raw: bytes, n: int) -> np.ndarray:
    lanes, steps, full = _lanes(n)
    models, coder = _Models(), _Coder(lanes)
    sizes = np.frombuffer(raw, "<u4", lanes).astype(np.int64)
    units = np.frombuffer(raw, "<u2", offset=4 * lanes).astype(_U)
    if not len(units) or sizes.sum() != len(units):
        raise ValueError("a block is damaged")
    at, code = np.cumsum(sizes) - sizes, np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _U(16)) | units.take(at, mode="clip")
        at += 1
    rows = np.zeros((steps, lanes), np.uint16)
    last = before = np.zeros(lanes, np.int64)

    def value(on, part: np.ndarray) -> np.ndarray:
        return np.minimum((code[on] - coder.low[on]) // part, _U((1 << _SHARE) - 1)).view(np.int64)

    for t in range(steps):
        if t == steps - 1:
            last, before = last[:full], before[:full]
        place = models.predict(last, before)
        on = slice(0, len(last))
        part = np.maximum(coder.range[on] >> _BITS, _U(1))
        above = code[on] - coder.low[on]
        place += _flag(above >= part * models.below[place + 1].view(_U)) + (above >= part * models.below[place + 2].view(_U)) + (above >= part * models.below[place + 3].view(_U))
        coder.low[on] += part * models.below[place].view(_U)
        coder.range[on] = part * models.share[place].view(_U)
        held = place & 3
        x = _either(held >> 1, _either(held & 1, models.says[0], models.says[2]), models.says[1])
        on = np.flatnonzero(held == 0)
        part = np.maximum(coder.range[on] >> _BITS, _U(1))
        missed = models.found.take(value(on, part))
        coder.narrow(on, part, models.under[missed], models.own[missed])
        new = np.flatnonzero(missed == _IDS)
        if len(new):
            some = on[new]
            part = np.maximum(coder.range[some] >> _BITS, _U(1))
            missed[new] = value(some, part)
            coder.narrow(some, part, missed[new], np.ones(len(new), np.int64))
        x[on] = missed
        for on, _ in coder.due():
            spot = at[on]
            code[on] = (code[on] << _U(16)) | units.take(spot, mode="clip")
            at[on] = spot + 1
        models.learn(x, place, missed)
        rows[t, : len(x)] = x
        last, before = x, last
    by_lane = rows.T
    return np.concatenate([by_lane[:full].ravel(), by_lane[full:, : steps - 1].ravel()])


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """ids below 2 ** 16 as: their number and a block's, each block's bytes and checksum, the blocks."""
    parts = [ids[k : k + block] for k in range(0, len(ids), block)]
    coded = [_encode_block(p) for p in parts]
    sums = [zlib.crc32(p.astype("<u2").tobytes()) for p in parts]
    return b"".join([np.array([len(ids), block], "<u8").tobytes(), np.array([len(c) for c in coded], "<u4").tobytes(), np.array(sums, "<u4").tobytes(), *coded])


def decode(raw: bytes) -> np.ndarray:
    n, block = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    count = -(-n // block)
    lengths, sums = np.frombuffer(raw, "<u4", count, 16).tolist(), np.frombuffer(raw, "<u4", count, 16 + 4 * count).tolist()
    at, out = 16 + 8 * count, [np.zeros(0, np.uint16)]
    for k in range(count):
        out.append(_decode_block(raw[at : at + lengths[k]], min(block, n - k * block)))
        at += lengths[k]
        if zlib.crc32(out[-1].astype("<u2").tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return np.concatenate(out)
