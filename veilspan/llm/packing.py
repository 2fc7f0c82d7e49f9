"""Sum-of-squares online packing of tokenised documents into fixed windows.

``levels[h]`` counts the open windows filled to ``h`` tokens. A document's remainder of ``r`` tokens
(its whole multiples of the window length stand alone) goes to the open window, or to a new one,
whose change of fill makes the sum of squared level counts smallest; ties go to the fullest window.
When a task's input ends, or more than ``max_open`` windows are open, open windows are filled up with
pieces cut from the emptiest, so that a task pads one window at most.

Packing is local to a task: no exchange, memory bounded by ``max_open`` windows and one batch, and a
lost task is packed anew from its own input. ``sequence_id`` holds the task's number in its high bits.

Defined cases: a null or empty text has its end token alone; repeated rows are documents of their
own; a null doc_id is carried; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilspan.llm.store import small_batches, trim
from veilspan.llm.tokens import encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]

#: (doc_id, start, ids as 16-bit bytes, tokens of its document)
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Pieces in, full windows out; ``finish`` gives the rest."""

    def __init__(self, window: int = 2048, max_open: int = 8192):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def choose(self, r: int) -> int:
        """The level to place ``r`` tokens on; 0 is a new window."""
        n, w = self.levels, self.window
        to = 2 * n[r : w + 1] + 1  # growth of the level reached
        to[-1] = 0  # a full window is open no more
        change = np.where(n[: w - r + 1] > 0, to - 2 * n[: w - r + 1] + 1, np.iinfo(np.int64).max)
        change[0] = to[0]
        return int(w - r - np.argmin(change[::-1]))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        r = len(piece[2]) // 2
        h = self.choose(r)
        if h:
            held = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if h + r == self.window:
            yield held
        else:
            self.open[h + r].append(held)
            self.levels[h + r] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                yield from self.drain(last=False)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        w, total = self.window, len(ids) // 2
        whole = total - total % w
        for at in range(0, whole, w):
            yield [(doc_id, at, ids[2 * at : 2 * (at + w)], total)]
        if whole < total:
            yield from self.place((doc_id, whole, ids[2 * whole :], total))

    def drain(self, last: bool = True) -> Iterator[list[Piece]]:
        """Fill the fullest open windows with pieces cut from the emptiest."""
        held = [(h, x) for h in range(self.window, 0, -1) for x in self.open[h]]
        self.open = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.n_open = 0
        i, j = 0, len(held) - 1
        while i < j:
            h, into = held[i]
            while h < self.window and j > i:
                fill, giver = held[j]
                doc_id, start, ids, total = giver.pop()
                n = len(ids) // 2
                cut = max(0, n - (self.window - h))
                if cut:
                    giver.append((doc_id, start, ids[: 2 * cut], total))
                into.append((doc_id, start + cut, ids[2 * cut :], total))
                h += n - cut
                held[j] = (fill - n + cut, giver)
                if not giver:
                    j -= 1
            held[i] = (h, into)
            if h == self.window:
                yield into
                i += 1
        for h, x in held[i : j + 1]:
            if last:
                yield x
            elif h:
                self.open[h].append(x)
                self.levels[h] += 1
                self.n_open += 1


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, doc_id: str = "doc_id", text: str = "text", max_open: int = 8192
) -> DataFrame:
    """One row per piece: where its document's ids lie, in which sequence, at which offset."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << 36
        end = int(end_id).to_bytes(2, "little")
        rows: list[tuple] = []

        def emit(full: list[Piece]) -> None:
            nonlocal sequence
            size, offset = sum(len(p[2]) // 2 for p in full), 0
            for d, start, ids, total in full:
                crc = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                rows.append((d, start, len(ids) // 2, crc, total, sequence, offset, size))
                offset += len(ids) // 2
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for d, ids in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist()), strict=True):
                    for full in packer.add(d, ids + end):
                        emit(full)
                if len(rows) >= 20_000:
                    yield flush()
        for full in packer.drain():
            emit(full)
        if rows:
            yield flush()
        trim()

    chosen = small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(task, PIECES)
