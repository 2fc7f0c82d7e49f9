"""An adaptive context-mixing range coder for 16-bit token ids.

Ids are cut into blocks; every block starts from an empty model, has its own coded words and a crc32,
and can be decoded alone. An id's probability mixes three predictions:

* order 2: the id that followed the two ids before, found by a hash of them;
* order 1: the id that followed the id before;
* order 0: the frequencies of all ids so far, halved from time to time, with one count for each id unseen.

The first two put their weight on one id each and know how often it came true in a row; how much weight
each order gets is learned within the block, for every pair of these confidences, from how often each
order was right there. The mixed distribution is what the arithmetic coder uses: every id is one step of it,
and nothing is stored beside the coded words.

A block is dealt to lanes, runs of neighbouring ids that are coded side by side with one numpy operation
for all; the lanes share the block's model, which learns from all of them after every step. Coder words
stand in the order in which the decoder asks for them; zeros at the end are left out. An id that a higher order names is
always coded as named, so order 0's share of it is lost: below a hundredth of the size on texts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VSRC"
VERSION = 2
_HEAD = struct.Struct("<4sBII")  # magic, version, ids in a block, blocks
_LANES, _STEPS = 12_288, 64  # lanes at most; ids in a lane at least, where the block allows it
_HASH = 18  # bits of the order-2 table
_CERTAIN = 7  # the highest confidence, 3 bits
_SEEN = 32  # counts that one occurrence adds
_FULL = 1 << 21  # counts are halved beyond this total
_SURE = 7  # an order's weight is at most 2 ** _SURE that of order 0
_AGED = 1 << 16
_WORD, _WINDOW = 16, 48
_LOW = (1 << _WINDOW - _WORD) - 1
_BUCKETS = 14  # bits of the decoder's table from counts to ids


class _Orders:
    """What the lanes of a block have learned so far."""

    def __init__(self, top: int, lanes: int):
        self.top = top
        self.counts = np.ones(top, dtype=np.int64)
        self.last = np.zeros(1 << 16, dtype=np.int32)  # id << 3 | confidence
        self.last2 = np.zeros(1 << _HASH, dtype=np.int32)
        self.right = np.ones((2 << 6, 3), dtype=np.int64)  # by confidences: order 0, 1, 2 had the id
        self.right[:, 0] = 4
        self.prev = np.zeros(lanes, dtype=np.int32)
        self.older = np.zeros(lanes, dtype=np.int32)
        self.news: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        """Take the ids since the last call into order 0."""
        if self.news:
            self.counts += np.bincount(np.concatenate(self.news), minlength=self.top) * _SEEN
            self.news = []
        while self.counts.sum() > _FULL:
            self.counts = (self.counts + 1) >> 1
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.total = int(self.ends[-1])
        self.shift = max(0, self.total.bit_length() - _BUCKETS)
        self.inverse: np.ndarray | None = None
        self.weigh()

    def weigh(self) -> None:
        """The orders' shares, in counts of order 0."""
        zero, most = self.right[:, 0], self.total << _SURE
        self.mass1 = np.clip(self.total * self.right[:, 1] // zero, 1, most)
        self.mass2 = np.clip(self.total * self.right[:, 2] // zero, 1, most)
        self.edge = self.total + self.mass2
        self.all = self.edge + self.mass1

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: both named ids and the context of their confidences."""
        if n < len(self.prev):
            self.prev, self.older = self.prev[:n], self.older[:n]
        self.at2 = ((self.prev * np.int32(0x3A4B) ^ self.older * np.int32(0x6C8E9CF5)) * np.int32(0x5851F42D)) >> 7 & (1 << _HASH) - 1
        self.s1, self.s2 = self.last[self.prev], self.last2[self.at2]
        self.c1, self.c2 = self.s1 >> 3, self.s2 >> 3
        context = (self.s2 & 7) << 3 | self.s1 & 7
        context += (self.c1 == self.c2).view(np.int8) << np.int32(6)
        self.context = context

    def find(self, counts: np.ndarray) -> np.ndarray:
        """The ids whose order-0 counts hold ``counts``."""
        if self.inverse is None:
            first = (np.append(self.begins, self.total) + (1 << self.shift) - 1) >> self.shift
            self.inverse = np.repeat(np.arange(self.top), np.diff(first))
        ids = self.inverse[counts >> self.shift]
        off = np.flatnonzero(counts >= self.ends[ids])
        ids[off] = np.searchsorted(self.ends, counts[off], side="right")
        return ids

    def learn(self, now: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, step: int) -> None:
        fresh = now << 3
        for table, at, s, hit in ((self.last, self.prev, self.s1, now == self.c1), (self.last2, self.at2, self.s2, hit2)):
            sure = s & 7
            table[at] = np.where(hit, s + (sure < _CERTAIN), np.where(sure > 0, s - 1, fresh))
        self.right += np.bincount(self.context * 3 + (hit1 + 2 * hit2.view(np.int8)), minlength=self.right.size).reshape(self.right.shape)
        old = self.right.sum(axis=1) > _AGED
        if old.any():
            self.right[old] = (self.right[old] + 1) >> 1
        self.older, self.prev = self.prev, now
        self.news.append(now)
        if step < 32 or step & 3 == 3:
            self.refresh()
        else:
            self.weigh()


def _deal(n: int) -> tuple[int, np.ndarray]:
    """Steps, and where each lane's ids begin and end: lanes of equal length, the first ones longer by one at most."""
    lanes = max(1, min(_LANES, n // _STEPS))
    bounds = np.arange(lanes + 1) * (n // lanes) + np.minimum(np.arange(lanes + 1), n % lanes)
    return -(-n // lanes), bounds


def _encode_block(ids: np.ndarray) -> tuple[int, bytes]:
    """The number above all ids, and the coded words."""
    top = int(ids.max()) + 1
    steps, bounds = _deal(len(ids))
    lengths, lanes = np.diff(bounds), len(bounds) - 1
    grid = np.zeros((steps, lanes), dtype=np.int32)
    body = steps - (len(ids) % lanes > 0)
    whole = bounds[:-1, None] + np.arange(body)
    grid[:body] = ids[whole].T
    if body < steps:
        grid[body, : len(ids) % lanes] = ids[bounds[1 : len(ids) % lanes + 1] - 1]
    model = _Orders(top, lanes)
    low, width = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << _WINDOW, dtype=np.int64)
    digits, owners = [], []
    for t in range(steps):
        n = lanes if t < body else int((lengths > t).sum())
        now = grid[t, :n]
        model.predict(n)
        hit2 = now == model.c2
        hit1 = (now == model.c1) & ~hit2
        begin, count = model.begins[now], model.counts[now]
        for hit, at, mass in ((hit1, model.edge, model.mass1), (hit2, None, model.mass2)):
            k = np.flatnonzero(hit)
            begin[k] = model.total if at is None else at[model.context[k]]
            count[k] = mass[model.context[k]]
        unit = width[:n] // model.all[model.context]
        low[:n] += unit * begin
        width[:n] = unit * count
        k = np.flatnonzero(width[:n] <= _LOW)
        while len(k):
            full = low[k]
            digits.append(full >> _WINDOW - _WORD)
            owners.append(k)
            low[k] = (full & _LOW) << _WORD
            width[k] <<= _WORD
            k = k[width[k] <= _LOW]
        model.learn(now, hit2, hit1, t)
    events = sum(map(len, owners))
    low = (low + _LOW) & ~_LOW  # still within the width, which is above _LOW: the words after the next one are zeros
    for _ in range(_WINDOW // _WORD):
        digits.append(low >> _WINDOW - _WORD)
        owners.append(np.arange(lanes))
        low = (low & _LOW) << _WORD
    owner = np.concatenate(owners).astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    words = np.concatenate(digits)[order]
    over = np.flatnonzero(words >> _WORD)
    while len(over):  # carries, towards the lane's first word
        words[over] -= 1 << _WORD
        over -= 1
        words[over] += 1
        over = over[words[over] >> _WORD > 0]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    size = np.bincount(owner, minlength=lanes)
    start = np.cumsum(size) - size
    asked = np.concatenate([(start[:, None] + np.arange(_WINDOW // _WORD)).ravel(), place[:events] + _WINDOW // _WORD])
    asked = words[asked]
    return top, asked[: np.flatnonzero(asked)[-1] + 1 if asked.any() else 0].astype("<u2").tobytes()


def _decode_block(n: int, top: int, words: np.ndarray) -> np.ndarray:
    steps, bounds = _deal(n)
    lengths, lanes = np.diff(bounds), len(bounds) - 1
    coded, words = len(words), np.append(words.astype(np.int64), np.zeros(2 * lanes * (_WINDOW // _WORD), dtype=np.int64))
    at = lanes * (_WINDOW // _WORD)
    first = words[:at].reshape(lanes, -1)
    code = first[:, 0] << 2 * _WORD | first[:, 1] << _WORD | first[:, 2]
    width = np.full(lanes, 1 << _WINDOW, dtype=np.int64)
    body = steps - (n % lanes > 0)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    model = _Orders(top, lanes)
    for t in range(steps):
        m = lanes if t < body else int((lengths > t).sum())
        model.predict(m)
        unit = width[:m] // model.all[model.context]
        count = code[:m] // unit
        other = count < model.total
        hit2 = ~other & (count < model.edge[model.context])
        hit1 = ~other & ~hit2
        now = grid[t, :m]
        k = np.flatnonzero(other)
        ids = model.find(count[k])
        now[k] = ids
        begin, wide = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        begin[k], wide[k] = model.begins[ids], model.counts[ids]
        for hit, named, edge, mass in ((hit1, model.c1, model.edge, model.mass1), (hit2, model.c2, None, model.mass2)):
            k = np.flatnonzero(hit)
            now[k] = named[k]
            begin[k] = model.total if edge is None else edge[model.context[k]]
            wide[k] = mass[model.context[k]]
        code[:m] -= unit * begin
        width[:m] = unit * wide
        k = np.flatnonzero(width[:m] <= _LOW)
        while len(k):
            code[k] = code[k] << _WORD | words[at : at + len(k)]
            at += len(k)
            width[k] <<= _WORD
            k = k[width[k] <= _LOW]
        model.learn(now, hit2, hit1, t)
    if at < coded:
        raise ValueError("coded words are left over")
    out = np.empty(n, dtype="<u2")
    out[bounds[:-1, None] + np.arange(body)] = grid[:body].T
    if body < steps:
        out[bounds[1 : n % lanes + 1] - 1] = grid[body, : n % lanes]
    return out


def encode(ids: np.ndarray, block: int = 4 << 20) -> bytes:
    """A container of independently decodable blocks of ``block`` ids at most, all of one size or one less."""
    ids = np.ascontiguousarray(ids, dtype="<u2")
    parts, table = [], []
    for part in np.array_split(ids, -(-len(ids) // block)) if len(ids) else ():
        top, words = _encode_block(part)
        parts.append(words)
        table.append((len(part), top, len(words), zlib.crc32(part.tobytes())))
    rows = np.array(table, dtype="<u4").reshape(-1, 4)
    return b"".join([_HEAD.pack(MAGIC, VERSION, block, len(parts)), rows.tobytes(), *parts])


def decode(data: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of all blocks, or of the blocks numbered in ``only``; a damaged block raises."""
    magic, version, _, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token container of this version")
    table = np.frombuffer(data, "<u4", 4 * blocks, _HEAD.size).reshape(-1, 4).astype(np.int64)
    begins = _HEAD.size + 16 * blocks + np.cumsum(table[:, 2]) - table[:, 2]
    found = [np.zeros(0, "<u2")]
    for k in range(blocks) if only is None else only:
        n, top, size, crc = table[k].tolist()
        try:
            ids = _decode_block(n, top, np.frombuffer(data, "<u2", size // 2, int(begins[k])))
        except (IndexError, ValueError, ZeroDivisionError) as e:
            raise ValueError(f"block {k} is damaged") from e
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        found.append(ids)
    return np.concatenate(found)
