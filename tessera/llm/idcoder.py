"""A range coder for blocks of token ids, driven by a mix of order-0, order-1 and order-2 predictions.

Each block starts from nothing, so blocks can be decoded alone; many blocks are coded in lockstep, one step of numpy for an
id of every block, with one model that the encoder and the decoder share.

The model.  Two tables remember which id followed the last id, and which followed the (hashed) last two, with a confidence from
0 (nothing yet) to 3.  The pair of confidences, and whether both name the same id, is a state; the mix's weights in a state
are the shares of times that order 2 was right, and that order 1 was and order 2 wasn't, both adaptive.  The rest goes to order 0, an
adaptive distribution over 16 classes of ids, half octaves, within which ids are equally likely.

The code.  Of 2**32 equal parts of the range, order 2's id has the first, order 1's the next, and each class a slice of the
rest, cut evenly for its ids.  ``low`` has 64 bits, of which the upper 16 go out as a digit when the range allows; a carry is
added to the digit before, and digits are brought below 2**16 in one pass at the end.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block, and blocks that are coded in lockstep.
BLOCK = 1024
LANES = 8192
LIMIT = 1 << 16  # ids are below it
ONE_BITS, TWO_BITS = 10, 11
STATES = 32
RATE = 5
#: Shares are in 2**16; orders 1 and 2 leave at least ROOM to the classes.
WHOLE, ROOM, LEAST = 1 << 16, 1 << 12, 32
RIGHT, WRONG = np.int32(WHOLE - ROOM - LEAST), np.int32(LEAST - 1)
TOTAL = 1 << 14  # of the classes
#: Sizes of the classes are powers of two: 256 four times, then each power from 512 on twice.
BITS = np.array([8, 8, *np.repeat(np.arange(8, 15), 2)])
STARTS = np.concatenate([[0], np.cumsum(1 << BITS)])[:-1]
CLASSES = len(BITS)
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.int16), 1 << BITS)
SHIFT = (16 - BITS).astype(np.uint32)
FIRST = STARTS.astype(np.uint32) | SHIFT  # a class begins at a multiple of its size
FLOOR = 16  # the least width of a class
SPREAD = np.int16(TOTAL - CLASSES * FLOOR)  # what the classes share beyond that
NUMBERS = np.arange(CLASSES + 1, dtype=np.int16)[:, None]
U4, U16, U32, U48 = np.uint64(4), np.uint64(16), np.uint64(32), np.uint64(48)
SMALL = np.uint64(1 << 48)


class Model:
    """The state of a block in each lane; ``shares`` predicts the next id of every lane, ``learn`` takes it.  Numbers have 32 bits where these hold them."""

    def __init__(self, lanes: int) -> None:
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.one = np.zeros(lanes << ONE_BITS, np.int32)  # an id, and its confidence above bit 16
        self.two = np.zeros(lanes << TWO_BITS, np.int32)
        self.base1, self.base2, self.base_state = self.lane << ONE_BITS, self.lane << TWO_BITS, self.lane * STATES
        self.right = np.full(lanes * STATES, (WHOLE // 8) * (WHOLE + 1), np.uint32)  # order 1's share above order 2's
        self.ends = np.repeat(NUMBERS * (SPREAD // np.int16(CLASSES)), lanes, axis=1)  # where classes begin and end, without their floors
        self.flat, self.inner, self.change = self.ends.reshape(-1), self.ends[1:-1], np.empty((CLASSES - 1, lanes), np.int16)
        self.last = self.before = np.zeros(lanes, np.uint32)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """(m2, m1): what order 2's and order 1's ids get of WHOLE."""
        self.at1 = (self.last & ((1 << ONE_BITS) - 1)) + self.base1
        self.at2 = (((self.last * 0x9E5 + self.before * 0x3B1F3) >> 4) & ((1 << TWO_BITS) - 1)) + self.base2  # of the products the low bits count
        self.e1, self.e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.s1, self.s2 = self.e1 & 0xFFFF, self.e2 & 0xFFFF
        self.state = self.base_state + ((self.e2 >> 14 & 12) + (self.e1 >> 16) + ((self.s1 == self.s2).view(np.int8) << 4))
        both = self.right.take(self.state)
        self.m2, self.m1 = both & (WHOLE - 1), both >> 16
        return self.m2, self.m1

    def slices(self, kind: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's class begins in its room, and its width."""
        at, floor = kind.astype(np.int64), kind * np.int16(FLOOR)
        at *= self.lanes
        at += self.lane
        begin = (room * (self.flat.take(at) + floor).view(np.uint16)) >> 14
        at += self.lanes
        floor += FLOOR
        return begin, ((room * (self.flat.take(at) + floor).view(np.uint16)) >> 14) - begin

    @staticmethod
    def _nearer(share: np.ndarray, hit: np.ndarray) -> np.ndarray:
        change = hit * (RIGHT - WRONG)
        change += WRONG
        change -= share.view(np.int32)
        change >>= RATE
        change += share.view(np.int32)
        return change.view(np.uint32)

    def learn(self, ids: np.ndarray, same1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, kind: np.ndarray) -> None:
        """same1: order 1 was right; hit1: and order 2 wasn't."""
        self.right[self.state] = (self._nearer(self.m1, hit1) << 16) | self._nearer(self.m2, hit2)
        once = ids.view(np.int32) | (1 << 16)
        most = once | (3 << 16)
        self.one[self.at1] = np.where(same1, np.minimum(self.e1 + (1 << 16), most), once)
        self.two[self.at2] = np.where(hit2, np.minimum(self.e2 + (1 << 16), most), once)
        np.subtract(kind, NUMBERS[1:-1], out=self.change)
        self.change >>= 15  # -1 where a class ends after this kind
        self.change &= SPREAD
        self.change -= self.inner
        self.change >>= RATE
        self.inner += self.change
        self.before, self.last = self.last, ids


def _sizes(unit: np.ndarray, start: np.ndarray, m2: np.ndarray, m1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
    """Puts the parts of orders 1 and 2 where these were right; ``unit`` becomes the sizes."""
    most = m2 << 16
    np.copyto(start, most, where=hit1)
    start *= ~hit2
    np.copyto(unit, m1 << 16, where=hit1)
    np.copyto(unit, most, where=hit2)


def encode(blocks: np.ndarray) -> list[np.ndarray]:
    """Words (uint16) of each row of ``blocks``, ids below LIMIT."""
    lanes, length = blocks.shape
    model = Model(lanes)
    digits = np.zeros((2 * length + 8) * lanes, np.uint32)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max)
    at = model.lane + lanes  # of the next digit; the first row stays empty, for no carry
    for row in np.ascontiguousarray(blocks.T):
        m2, m1 = model.shares()
        ids, kind = row.astype(np.uint32), CLASS_OF.take(row)
        taken = m2 + m1
        begin, size = model.slices(kind, WHOLE - taken)
        shift = SHIFT.take(kind)
        size <<= shift
        same1, hit2 = model.s1 == ids.view(np.int32), model.s2 == ids.view(np.int32)
        hit1 = same1 > hit2
        start = ((taken + begin) << 16) + (ids & ((LIMIT - 1) >> shift)) * size
        _sizes(size, start, m2, m1, hit2, hit1)
        part = width >> U32
        step = start * part
        low += step
        if (carry := np.flatnonzero(low < step)).size:
            digits[at[carry] - lanes] += 1
        width = size * part
        out = width < SMALL
        digits[at] = low >> U48
        shift = out.astype(np.uint64) << U4
        low <<= shift
        width <<= shift
        at += out * lanes
        if (more := np.flatnonzero(width < SMALL)).size:
            digits[at[more]] = low[more] >> U48
            low[more] <<= U16
            width[more] <<= U16
            at[more] += lanes
        model.learn(ids, same1, hit2, hit1, kind)
    for _ in range(4):
        digits[at] = low >> U48
        low <<= U16
        at += lanes
    full = np.flatnonzero(digits >= WHOLE)
    while full.size:
        carry = digits[full] >> 16
        digits[full] &= WHOLE - 1
        full -= lanes
        digits[full] += carry
        full = full[digits[full] >= WHOLE]
    words = np.ascontiguousarray(digits.reshape(-1, lanes)[1:].astype(np.uint16).T)
    return [w[:n] for w, n in zip(words, (at // lanes - 1).tolist(), strict=True)]


def decode(words: list[np.ndarray], length: int) -> np.ndarray:
    """The ids (uint16, a row of ``length`` for each block) of what ``encode`` gave."""
    lanes = len(words)
    rows = np.zeros((lanes, max(2 * length, *map(len, words)) + 9), np.uint16)
    for row, w in zip(rows, words, strict=True):
        row[: len(w)] = w
    digits = rows.reshape(-1)
    model = Model(lanes)
    found = np.empty((length, lanes), np.uint16)
    code, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max)
    at = model.lane * rows.shape[1]
    for _ in range(4):
        code = (code << U16) | digits[at]
        at += 1
    for t in range(length):
        m2, m1 = model.shares()
        taken = m2 + m1
        part = width >> U32
        value = (code // part).astype(np.uint32)
        top = value >> 16
        hit2 = top < m2
        hit1 = (top < taken) > hit2
        room = WHOLE - taken
        # a class ends at or before a place of the room if its end is at most this
        most = ((((top - taken + 1) << 14) - 1) // room).astype(np.int16)
        kind = np.add.reduce((model.inner + NUMBERS[1:-1] * np.int16(FLOOR) <= most).view(np.int8), axis=0, dtype=np.int8).astype(np.int16)
        begin, size = model.slices(kind, room)
        first = FIRST.take(kind)
        shift = first & 15
        size <<= shift
        start = (taken + begin) << 16
        own = np.minimum((value - start) // size, (LIMIT - 1) >> shift)
        ids = (first - shift) + own
        np.copyto(ids, model.s1.view(np.uint32), where=hit1)
        np.copyto(ids, model.s2.view(np.uint32), where=hit2)
        start += own * size
        _sizes(size, start, m2, m1, hit2, hit1)
        code -= start * part
        width = size * part
        out = width < SMALL
        shift = out.astype(np.uint64) << U4
        code <<= shift
        code |= digits.take(at) * out
        width <<= shift
        at += out
        if (more := np.flatnonzero(width < SMALL)).size:
            code[more] = (code[more] << U16) | digits[at[more]]
            width[more] <<= U16
            at[more] += 1
        found[t] = ids
        model.learn(ids, model.s1 == ids.view(np.int32), hit2, hit1, CLASS_OF.take(ids, mode="clip"))
    return np.ascontiguousarray(found.T)
