"""Byte-pair merges of many short pieces at once.

A column of a matrix holds one piece's symbols. Each round merges, in every column, the pair of lowest rank, the leftmost of
equal ones, as the tokenizers library does piece by piece, so the ids are the same; columns without
a pair to merge are put aside. The pairs' ranks lie in a hash table that is asked for all columns together.
"""

from __future__ import annotations

import numpy as np

_SLOTS = 18  # bits of the table of pairs at least; four slots a pair at least
_NONE = 1 << 30  # above every rank << _PLACE
_PLACE = 6  # bits of a place within a piece
LONGEST = 32  # bytes of a piece
_PAD = 0xFFFF  # no symbol


class Merges:
    def __init__(self, letters: list[int], pairs: list[tuple[int, int, int]]):
        """``letters``: the id of each byte. ``pairs``: (left, right, merged) by rank."""
        left, right, merged = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        if max(letters + merged.tolist()) >= _PAD or len(merged) >= _NONE >> _PLACE:
            raise ValueError("ids must be below 65,535")
        self.letters = np.array(letters, dtype=np.int32)
        self.merged = merged.astype(np.int32)
        bits = max(_SLOTS, (4 * len(merged)).bit_length())
        self.shift, self.last = np.uint32(32 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 0xFFFFFFFF, dtype=np.uint32)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        keys, rank = (left << 16 | right).astype(np.uint32), np.arange(len(merged))
        slot = self._slot(keys)
        while len(rank):  # those that find their slot taken go to the next one
            free = self.keys[slot] == 0xFFFFFFFF
            claim = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[claim]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], rank[won] << _PLACE
            rest = np.ones(len(rank), dtype=bool)
            rest[won] = False
            keys, rank, slot = keys[rest], rank[rest], slot[rest]
            slot = np.where(self.keys[slot] == 0xFFFFFFFF, slot, slot + 1 & self.last)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs: rank << _PLACE, or _NONE."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self._slot(keys)
        held = self.keys.take(slot)
        out = self.ranks.take(slot)
        other = held != keys
        out[other] = _NONE
        k = np.flatnonzero(other & (held != 0xFFFFFFFF))
        slot = slot[k]
        while len(k):
            slot = slot + 1 & self.last
            held = self.keys.take(slot)
            hit = held == keys[k]
            out[k[hit]] = self.ranks.take(slot[hit])
            more = ~hit & (held != 0xFFFFFFFF)
            k, slot = k[more], slot[more]
        return out

    def __call__(self, data: bytes, sizes: np.ndarray) -> tuple[list[int], list[bytes]]:
        """The ids (unsigned 16-bit, little-endian) of pieces of 1 to ``LONGEST`` bytes, which follow one another in
        ``data``, and before them the pieces' numbers in the order of the ids."""
        symbols = self.letters.take(np.frombuffer(data, np.uint8))
        begin = np.cumsum(sizes) - sizes
        order, out, low = [], [], 0
        for high in (10, 16, LONGEST):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for a in range(0, len(own), 1 << 14):
                part = own[a : a + (1 << 14)]
                ids, counts = self._merge(symbols, begin[part], sizes[part], high)
                stops = np.cumsum(counts) * 2
                order += part.tolist()
                out += [ids[x:y] for x, y in zip((stops - 2 * counts).tolist(), stops.tolist(), strict=True)]
        return order, out

    def _merge(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, high: int) -> tuple[bytes, np.ndarray]:
        """The ids of all pieces in their order, and how many each has."""
        place = np.arange(high + 1)[:, None]
        now = symbols.take(np.minimum(begin + place, len(symbols) - 1))
        now[place >= sizes] = _PAD  # the last row is never anything else
        done = now.copy()
        columns = np.arange(len(sizes))
        order = self._find(now[:-1].ravel(), now[1:].ravel()).reshape(high, -1)
        order += place[:-1].astype(np.int32)
        after = np.repeat((place + 1).astype(np.int8), len(sizes), axis=1)  # the next and the previous symbol's row
        before = after - np.int8(2)
        while True:
            best = order.min(axis=0)
            live = best < _NONE
            if live.sum() < 0.75 * len(live) or not live.any():
                done[:, columns[~live]] = now[:, ~live]
                now, order, after, before = (np.compress(live, x, axis=1) for x in (now, order, after, before))
                columns, best = columns[live], best[live]
                if not len(columns):
                    break
                live = np.ones(len(columns), dtype=bool)
            n, column = len(columns), np.flatnonzero(live)
            best = best[column]
            symbol, pair, following, previous = now.ravel(), order.ravel(), after.ravel(), before.ravel()  # views
            row = best & (1 << _PLACE) - 1
            at = row * n + column
            gone = following.take(at).astype(np.int64) * n + column
            behind = following.take(gone)
            symbol[gone], pair[gone] = _PAD, _NONE
            made = self.merged.take(best >> _PLACE)
            symbol[at], following[at] = made, behind
            behind = behind.astype(np.int64) * n + column
            previous[behind] = row
            pair[at] = self._find(made, symbol.take(behind)) + row
            ahead = previous.take(at).astype(np.int32)
            inner = np.flatnonzero(ahead >= 0)
            ahead = ahead[inner]
            to = ahead * n + column[inner]
            pair[to] = self._find(symbol.take(to), made[inner]) + ahead
        held = done != _PAD
        return done.T[held.T].astype("<u2").tobytes(), held.sum(axis=0)
