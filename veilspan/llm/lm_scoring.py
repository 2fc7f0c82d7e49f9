"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

All documents are dealt to chunks of bounded text by a hash of the whole row. A chunk sends each
slice of the hash space the sorted distinct n-grams it holds there, delta-coded, with their training
counts; the slice adds up and answers with totals alone, in the same order. So every occurrence is
counted, a frequent word costs a chunk one entry however often it occurs, and neither a word nor a
source makes a task large: chunks and slices grow in number, not in size.

Weights depend on the bucket (by powers of two) of the context's count and are learnt by expectation
maximisation on a part of the training documents, whose own occurrence is deleted from every count;
what reaches the driver for that is a histogram of bounded size.

Tokens: words (runs of bytes outside 0x20 and 0x09-0x0D), A-Z lower-cased, then one end per document.

Defined cases: a null or empty text has the end alone; repeated rows count each; a null doc_id is
trained on and scored; without training documents all counts are 0 and the uniform estimate is left;
an empty table gives an empty result; other columns are not read. N-grams are told apart by hashes:
64 bits for words, and for bigrams 11 bits more than the text's bytes need (40 at least).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textbuf
from veilspan.llm.store import written

_END = np.uint64(0x2545F4914F6CDD1D)
_BUCKETS, _Q1, _Q2 = 24, 160, 80
SENT = "slice int, chunk int, gram int, n int, width int, deltas binary, counts binary"
ANSWERED = "chunk int, gram int, slice int, wide boolean, counts binary, tokens long, types long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Shape:
    """How the work is cut."""

    chunks: int
    held_chunks: int
    slices: int
    bits: int  # of a bigram's hash


def _shape(total_bytes: int, chunk_bytes: int) -> Shape:
    chunks = max(1, math.ceil(total_bytes / chunk_bytes))
    bits = min(64, max(40, math.ceil(math.log2(max(total_bytes, 2))) + 11))
    return Shape(chunks, max(1, chunks // 6), max(1, math.ceil(total_bytes / (2 * chunk_bytes))), bits)


class _Chunk:
    """Tokens of a chunk's documents: their places in the sorted distinct words and bigrams."""

    def __init__(self, table: pa.Table, bits: int):
        table = table.combine_chunks()
        self.table, n = table, table.num_rows
        column = table.column("text").combine_chunks()
        hashes, counts = [], []
        for a, b in textbuf.pieces(column):
            data, offsets = textbuf.text_bytes(column.slice(a, b - a))
            starts, ends, first = textbuf.word_bounds(data, offsets)
            hashes.append(textbuf.word_hashes(data, starts, ends, lower=True))
            counts.append(np.diff(first))
        words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        per = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        self.stop = np.cumsum(per + 1)  # after each document's end
        self.first = self.stop - per - 1
        tokens = np.insert(words, np.cumsum(per), _END)
        self.doc = np.repeat(np.arange(n), per + 1)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = _END
        train = ~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
        weight = train[self.doc].astype(np.int64)
        pair = textbuf.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens) >> np.uint64(64 - bits)
        # The end is always among the words: it is the context of every first word.
        self.words, at = np.unique(np.append(tokens, _END), return_inverse=True)
        self.word_at, self.end_at = at[:-1], int(at[-1])
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)
        self.counts = [np.bincount(self.word_at, weight, len(self.words)).astype(np.int64), np.bincount(self.pair_at, weight, len(self.pairs)).astype(np.int64)]
        self.before_at = np.empty_like(self.word_at)
        self.before_at[1:] = self.word_at[:-1]
        self.before_at[self.first] = self.end_at

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 1, self.words, self.counts[0]
        yield 2, self.pairs, self.counts[1]


def _edges(sorted_: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Where each slice of the hash space begins."""
    top = np.array([(k << bits) // slices for k in range(1, slices)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_, top), [len(sorted_)]])


def _send(shape: Shape):
    def chunk(table: pa.Table) -> pa.Table:
        c = _Chunk(table, shape.bits)
        rows = []
        number = table.column("chunk")[0].as_py()
        for gram, sorted_, counts in c.grams():
            at = _edges(sorted_, shape.slices, 64 if gram == 1 else shape.bits)
            for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if a == b:
                    continue
                gaps = np.diff(sorted_[a:b], prepend=np.uint64(0))
                width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if b - a > 1 else 1
                body = gaps[:1].tobytes() + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                rows.append((s, number, gram, b - a, width, body, zlib.compress(counts[a:b].astype("<u4").tobytes(), 1)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int32()] * 5 + [pa.binary()] * 2
        return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["slice", "chunk", "gram", "n", "width", "deltas", "counts"])

    return chunk


def _hashes(n: int, width: int, body: bytes) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(body, np.uint8, 8)
    gaps[1:, :width] = np.frombuffer(body, np.uint8, offset=8).reshape(n - 1, width)
    return np.cumsum(gaps.view(np.uint64).reshape(-1), dtype=np.uint64)


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one slice's n-grams for each chunk that asked."""
    out = []
    for gram in (1, 2):
        t = table.filter(pc.equal(table.column("gram"), gram))
        if not t.num_rows:
            continue
        sizes = t.column("n").to_numpy()
        parts = [_hashes(n, w, b) for n, w, b in zip(sizes.tolist(), t.column("width").to_pylist(), t.column("deltas").to_pylist(), strict=True)]
        counts = np.concatenate([np.frombuffer(zlib.decompress(b), "<u4") for b in t.column("counts").to_pylist()])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(at, counts, len(keys)).astype(np.int64)
        found = totals[at]
        first = True
        slice_ = t.column("slice")[0].as_py()
        for chunk, a, n in zip(t.column("chunk").to_pylist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            mine = (int(totals.sum()), int((totals > 0).sum())) if first and gram == 1 else (0, 0)
            part = found[a : a + n]
            wide = bool(part.max() >> 32)
            out.append((chunk, gram, slice_, wide, zlib.compress(part.astype("<u8" if wide else "<u4").tobytes(), 1), *mine))
            first = False
    types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
    cols = list(zip(*out, strict=True)) or [[]] * 7
    return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["chunk", "gram", "slice", "wide", "counts", "tokens", "types"])


def _totals(c: _Chunk, answers: pa.Table) -> list[np.ndarray]:
    """Training counts of the chunk's distinct words and bigrams."""
    answers = answers.sort_by("slice")
    found = []
    for gram, want in ((1, len(c.words)), (2, len(c.pairs))):
        t = answers.filter(pc.equal(answers.column("gram"), gram))
        got = []
        for raw, wide in zip(t.column("counts").to_pylist(), t.column("wide").to_pylist(), strict=True):
            got.append(np.frombuffer(zlib.decompress(raw), "<u8" if wide else "<u4").astype(np.int64))
        counts = np.concatenate([*got, np.zeros(0, np.int64)])
        if len(counts) != want:
            raise ValueError("answers and chunk differ")
        found.append(counts)
    return found


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], _BUCKETS - 1)


def _estimates(c: _Chunk, totals: list[np.ndarray], n: int, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: the bucket of its context, the bigram and the unigram estimate; ``less``: occurrences deleted."""
    word, context, pair = totals[0][c.word_at] - less, totals[0][c.before_at] - less, totals[1][c.pair_at] - less
    p2 = np.where(context > 0, np.maximum(pair, 0) / np.maximum(context, 1), 0.0)
    return _bucket(np.maximum(context, 0)), np.minimum(p2, 1.0), np.maximum(word, 0) / max(n - less, 1)


def _histogram(shape: Shape, n: int):
    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.zeros(0, np.int64)
        if left.num_rows:
            c = _Chunk(left, shape.bits)
            b, p2, p1 = _estimates(c, _totals(c, right), n, 1)
            q2 = np.where(p2 > 0, np.minimum(1 - np.floor(4 * np.log2(np.maximum(p2, 1e-30))), _Q2 - 1), 0).astype(np.int64)
            q1 = np.where(p1 > 0, np.minimum(1 - np.floor(4 * np.log2(np.maximum(p1, 1e-45))), _Q1 - 1), 0).astype(np.int64)
            keys = (b * _Q2 + q2) * _Q1 + q1
        at, count = np.unique(keys, return_counts=True)
        return pa.table([pa.array(at, pa.int64()), pa.array(count, pa.int64())], names=["cell", "count"])

    return chunk


def learn_weights(cells: dict[int, int], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bucket x uniform, unigram, bigram) by expectation maximisation on held-out counts."""
    weights = np.tile(np.array([0.05, 0.55, 0.4]), (_BUCKETS, 1))
    if not cells:
        return weights
    at, count = (np.array(x) for x in zip(*sorted(cells.items()), strict=True))
    q1, q2, b = at % _Q1, at // _Q1 % _Q2, at // _Q1 // _Q2
    p = np.stack([np.full(len(at), uniform), np.where(q1 > 0, 2.0 ** ((0.5 - q1) / 4), 0), np.where(q2 > 0, np.minimum(2.0 ** ((0.5 - q2) / 4), 1), 0)], axis=1)
    count = count[:, None]
    for _ in range(rounds):
        share = weights[b] * p
        share *= count / share.sum(axis=1, keepdims=True)
        new = np.zeros_like(weights)
        np.add.at(new, b, share)
        total = new.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, np.maximum(new / np.maximum(total, 1e-12), 1e-6), weights)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _score(shape: Shape, n: int, types: int, weights: np.ndarray):
    uniform = 1.0 / (types + 1)

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        c = _Chunk(left, shape.bits)
        totals = _totals(c, right)
        word = totals[0][c.word_at]
        b, p2, p1 = _estimates(c, totals, n, 0)
        w = weights[b]
        score = np.log10(w[:, 0] * uniform + w[:, 1] * p1 + w[:, 2] * p2)
        base = np.log10((word + 1) / (n + types + 1))
        add = lambda x: np.add.reduceat(x, c.first)
        cols = [c.table.column("doc_id"), c.table.column("held_out"), c.stop - c.first, add((word > 0).astype(np.int64)), add(base), add(score)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)

    return chunk


def score(docs: DataFrame, held_out: Column, deleted: Column, chunk_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``held_out`` and ``deleted`` are conditions over ``doc_id``: rows the model doesn't learn from, and
    training rows that the weights are learnt on.
    """
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = _shape(int(total), chunk_bytes)
    own = F.xxhash64("doc_id", "text")
    false = F.lit(False)
    base = base.withColumn("held_out", F.coalesce(held_out, false)).withColumn("_part", F.coalesce(deleted, false) & ~F.col("held_out"))
    base = base.withColumn("chunk", F.when(F.col("_part"), F.pmod(own, F.lit(shape.held_chunks)) + shape.chunks).otherwise(F.pmod(own, F.lit(shape.chunks))).cast("int")).drop("_part")
    sent = base.groupBy("chunk").applyInArrow(_send(shape), SENT)
    answers = written(sent.groupBy("slice").applyInArrow(_answer, ANSWERED), "lm-answers", "none")
    sums = answers.agg(F.sum("tokens"), F.sum("types")).first()
    n, types = int(sums[0] or 0), int(sums[1] or 0)
    answers = answers.select("chunk", "gram", "slice", "wide", "counts")
    part = base.where(F.col("chunk") >= shape.chunks).groupBy("chunk").cogroup(answers.where(F.col("chunk") >= shape.chunks).groupBy("chunk"))
    cells = part.applyInArrow(_histogram(shape, n), "cell long, count long").groupBy("cell").agg(F.sum("count").alias("n")).collect()  # at most 307,200 cells
    weights = learn_weights({r["cell"]: r["n"] for r in cells}, 1.0 / (types + 1))
    scored = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shape, n, types, weights), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
