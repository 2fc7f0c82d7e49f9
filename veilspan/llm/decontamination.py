"""Benchmark decontamination by latent semantic retrieval.

The index: benchmark items become passages, passages become TF-IDF rows over the benchmark's own terms
(document frequencies from all corpus passages), and a distributed randomised SVD - each task returns
its share of Y'Y and Y'A, never a row - gives ``rank`` latent directions. The search: all texts are cut
into overlapping windows at two lengths, folded into the latent space, and compared by cosine with
every passage, in blocks of one matrix product; windows with fewer rare benchmark terms than a
paraphrase of any item would keep are passed over. As ``rank`` directions don't hold every passage of a
large benchmark, a passage is also looked up exactly, whatever the rank: where two thirds of its six
rarest terms lie within its length, the place is a candidate too. The decision: a candidate's neighbourhood must share a long common subsequence of words with
the passage found or with its whole item, or a shorter one together with the answer (the ``answer`` column,
else the rarest terms of the passage or the item), which is what a paraphrase keeps. Long items become
overlapping passages of 64 terms that begin at most 32 apart, so 64 words quoted from anywhere in an item hold 48 words of one passage.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, told apart
by 64-bit hashes. The index's size is bounded: more than ``max_terms`` terms raise. Texts are read
whole; nothing of the corpus is shuffled but one count per task and benchmark term.

Defined cases: a null or empty text matches nothing, a null or empty item is matched by nothing;
repeated rows and repeated items match each; an empty corpus or benchmark gives an empty result;
other columns are not read; a null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textbuf
from veilspan.llm.store import small_batches, trim

MATCHES = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, start_word long"
_STRIDE = 16
_LENGTHS = (2, 4)  # windows of 32 and 64 words
_ANCHORS = 6  # rarest terms by which a passage is looked up
_REACH = 80  # no passage is longer: pairs of such stretches hold any


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the first of each text."""
    hashes, first, base = [], [np.zeros(1, np.int64)], 0
    for a, b in textbuf.pieces(column):
        data, offsets = textbuf.text_bytes(column.slice(a, b - a))
        starts, ends, at = textbuf.word_bounds(data, offsets, textbuf.ALNUM_BYTE)
        hashes.append(textbuf.word_hashes(data, starts, ends, lower=True))
        first.append(at[1:] + base)
        base += int(at[-1])
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate(first)


@dataclass
class Item:
    item_id: int
    terms: np.ndarray
    answer: np.ndarray  # terms that a paraphrase must keep


class Vocabulary:
    """The benchmark's terms: hash to number, with a quick first look at 16 bits of the hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a known term, and its number."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[found] == hashes[at]
        return at[ok], found[ok]


@dataclass
class Index:
    items: list[Item]
    vocabulary: Vocabulary
    idf: np.ndarray
    folding: np.ndarray  # terms x rank
    passages: np.ndarray  # passages x rank, unit rows
    owner: np.ndarray
    bounds: list[tuple[int, int]]  # each passage's part of its item's terms
    answers: list[np.ndarray]  # terms that a paraphrase of the passage must keep
    anchor_first: np.ndarray  # by term: its part of the next two
    anchor_of: np.ndarray  # passage
    anchor_slot: np.ndarray  # which of the passage's rarest terms
    needed: np.ndarray  # by passage: how many of them a candidate has
    rare: float  # terms of at least this idf are rare: 30 % of every item's, or more
    least_rare: int  # rare terms a window must have to be looked at


def _cut(n: int, size: int = 64, least: int = 16) -> list[tuple[int, int]]:
    """Passages of an item of ``n`` terms: all of it, or where that is long, pieces of ``size`` that overlap by half or more."""
    if n < size + least:
        return [(0, n)]
    return [(a, a + size) for a in [*range(0, n - size, size // 2), n - size]]


def _rarest(place: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` distinct terms (numbers) of highest idf, ties by number."""
    distinct = np.unique(place)
    return distinct[np.lexsort((distinct, -idf[distinct]))][:n]


def _frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str) -> tuple[np.ndarray, int]:
    """In how many corpus passages (of 32 terms, none overlapping) each known term occurs, and of how many."""
    size = _STRIDE * 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            for a, b in textbuf.pieces(batch.column(0)):
                hashes, first = _terms(batch.column(0).slice(a, b - a))
                counts = np.diff(first)
                per = -(-counts // size)
                base = np.cumsum(per) - per
                at, term = vocabulary.place(hashes)
                doc = np.searchsorted(first, at, side="right") - 1
                passage = base[doc] + (at - first[doc]) // size
                total += int(per.sum())
                both = np.unique(passage * len(found) + term)
                found += np.bincount(both % max(len(found), 1), minlength=len(found))
        use = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(use, -1)), pa.array(np.append(found[use], total))], names=["term", "n"])

    rows = small_batches(docs).select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(vocabulary.hashes)), 0
    for r in rows:  # one per benchmark term
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, int(total)


def _rows(passages: list[list[int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit TF-IDF rows: row, term, weight."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    term = np.array([t for p in passages for t in p], dtype=np.int64)
    both, tf = np.unique(row * len(idf) + term, return_counts=True)
    row, term = both // len(idf), both % len(idf)
    weight = tf * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2, len(passages)))
    return row, term, weight / np.maximum(norm[row], 1e-12)


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, extra: int = 10, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """The first right singular vectors (terms x rank) of the TF-IDF rows of ``passages`` (one column
    ``terms``: term numbers). Every task returns two sums whose size doesn't depend on the rows."""
    n_terms = len(idf)
    wide = min(rank + extra, n_terms)
    probe = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, wide)))[0]
    spark = passages.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(probe)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            omega = held.value
            gram, back = np.zeros((omega.shape[1],) * 2), np.zeros((omega.shape[1], n_terms))
            for batch in batches:
                lists = batch.column(0).to_pylist()
                if not lists:
                    continue
                row, term, weight = _rows(lists, idf)
                y = np.zeros((len(lists), omega.shape[1]))
                np.add.at(y, row, weight[:, None] * omega[term])
                gram += y.T @ y
                np.add.at(back.T, term, weight[:, None] * y[row])
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([back.tobytes()], pa.binary())], names=["gram", "back"])

        gram, back = np.zeros((probe.shape[1],) * 2), np.zeros((probe.shape[1], n_terms))
        for r in passages.mapInArrow(task, "gram binary, back binary").toLocalIterator():
            gram += np.frombuffer(r["gram"]).reshape(gram.shape)
            back += np.frombuffer(r["back"]).reshape(back.shape)
        held.unpersist()
        # Y = QR with R'R = gram, so Q'A = R'^-1 (Y'A); eigenvectors stand in for R where Y has no full rank.
        value, vector = np.linalg.eigh(gram)
        keep = value > max(value.max(initial=0.0), 1e-300) * 1e-10
        b = (vector[:, keep] / np.sqrt(value[keep])).T @ back
        if not len(b):
            return np.zeros((n_terms, 0))
        _, _, right = np.linalg.svd(b, full_matrices=False)
        probe = right.T
    return probe[:, :rank]


def build(docs: DataFrame, benchmark: DataFrame, rank: int = 160, max_terms: int = 500_000, item_id: str = "item_id", item_text: str = "text", answer: str | None = None, text: str = "text") -> Index:
    """Fit the index: corpus frequencies from all documents, directions from all benchmark passages."""
    spark = docs.sparkSession
    columns = [benchmark[item_id].cast("long").alias("item_id"), F.coalesce(benchmark[item_text], F.lit("")).alias("text"), (benchmark[answer] if answer else F.lit(None)).cast("string").alias("answer")]
    rows = benchmark.select(*columns).orderBy("item_id", "text").collect()  # bounded: max_terms below
    texts, answers = pa.array([r["text"] for r in rows], pa.large_string()), pa.array([r["answer"] for r in rows], pa.large_string())
    hashes, first = _terms(texts)
    vocabulary = Vocabulary(hashes)
    if len(vocabulary.hashes) > max_terms:
        raise ValueError(f"the benchmark has over {max_terms} terms")
    found, total = _frequencies(docs, vocabulary, text)
    idf = np.log((1 + total) / (1 + np.minimum(found, total))) + 0.05
    told, told_first = _terms(answers)
    items, passages, owner, bounds, sure = [], [], [], [], []
    for k, r in enumerate(rows):
        own = hashes[first[k] : first[k + 1]]
        if not len(own):
            continue
        place = np.searchsorted(vocabulary.hashes, own)
        kept = np.unique(told[told_first[k] : told_first[k + 1]])
        for a, b in _cut(len(own)):
            passages.append(place[a:b].tolist())
            owner.append(len(items))
            bounds.append((a, b))
            sure.append(kept if len(kept) else vocabulary.hashes[_rarest(place[a:b], idf, 3)])
        items.append(Item(r["item_id"], own, kept if len(kept) else vocabulary.hashes[_rarest(place, idf, 3)]))
    if not items:
        return Index([], vocabulary, idf, np.zeros((len(idf), 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.int64), [], [], np.zeros(len(idf) + 1, np.int64), *[np.zeros(0, np.int64)] * 3, np.inf, 1)
    folding = randomised_svd(spark.createDataFrame([(p,) for p in passages], "terms array<long>").repartition(4), idf, min(rank, len(passages)))
    row, term, weight = _rows(passages, idf)
    latent = np.zeros((len(passages), folding.shape[1]))
    np.add.at(latent, row, weight[:, None] * folding[term])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    rare = min(float(np.sort(idf[p])[-max(1, round(0.3 * len(p)))]) for p in passages)
    least = max(1, int(0.4 * min(int((idf[p] >= rare).sum()) for p in passages)))
    anchors = [_rarest(np.array(p), idf, _ANCHORS) for p in passages]
    term, of = np.concatenate(anchors), np.repeat(np.arange(len(anchors)), [len(x) for x in anchors])
    slot = np.concatenate([np.arange(len(x)) for x in anchors])
    order = np.argsort(term, kind="stable")
    anchor_first = np.searchsorted(term[order], np.arange(len(idf) + 1))
    needed = np.array([-(-2 * len(x) // 3) for x in anchors])
    return Index(items, vocabulary, idf, (folding * idf[:, None]).astype(np.float32), latent.astype(np.float32), np.array(owner), bounds, sure, anchor_first, of[order], slot[order], needed, rare, least)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; one machine step per element of ``b``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    all_ = (1 << len(a)) - 1
    row = all_
    for x in b.tolist():
        if match := where.get(x):
            both = row & match
            row = (row + both | row - both) & all_
    return len(a) - bin(row).count("1")


def _exact(index: Index, at: np.ndarray, term: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, passage, first, last position in the text) wherever enough of a passage's rarest terms lie in two stretches side by side."""
    count = index.anchor_first[term + 1] - index.anchor_first[term]
    use = np.flatnonzero(count)
    count = count[use]
    place = np.repeat(use, count)
    entry = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.anchor_first[term[use]], count)
    stretches = np.diff(first) // _REACH + 1
    base = np.cumsum(stretches) - stretches
    within = at[place] - first[doc[place]]
    stretch = base[doc[place]] + within // _REACH
    n = len(index.needed)
    back = np.flatnonzero(within >= _REACH)
    pair = np.concatenate([stretch * n, (stretch[back] - 1) * n]) + index.anchor_of[np.concatenate([entry, entry[back]])]
    slot, where = index.anchor_slot[np.concatenate([entry, entry[back]])], np.concatenate([within, within[back]])
    pairs, found = np.unique(np.unique(pair * _ANCHORS + slot) // _ANCHORS, return_counts=True)
    pairs = pairs[found >= index.needed[pairs % n]]
    keep = np.flatnonzero(np.isin(pair, pairs))
    keep = keep[np.lexsort((where[keep], pair[keep]))]
    lo, hi = np.searchsorted(pair[keep], pairs), np.searchsorted(pair[keep], pairs, side="right") - 1
    row = np.searchsorted(base, pairs // n, side="right") - 1
    yield from zip(row.tolist(), (pairs % n).tolist(), where[keep[lo]].tolist(), where[keep[hi]].tolist(), strict=True)


def _cosine(index: Index, a: np.ndarray, b: np.ndarray) -> float:
    """TF-IDF cosine of two lists of hashes, over the benchmark's terms."""
    x, y = (np.bincount(index.vocabulary.place(h)[1], minlength=len(index.idf)) * index.idf for h in (a, b))
    return float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12))


def _near(index: Index, at: np.ndarray, term: np.ndarray, first: np.ndarray, doc: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, passage, first, last position in the text, cosine) of every window near a passage in the latent space."""
    per = -(-np.diff(first) // _STRIDE)
    base = np.concatenate([[0], np.cumsum(per)])
    block = base[doc] + (at - first[doc]) // _STRIDE
    n = int(base[-1])
    rare = np.concatenate([[0], np.cumsum(np.bincount(block[index.idf[term] >= index.rare], minlength=n))])
    starts, stops = [], []
    of = np.repeat(np.arange(len(per)), per)
    for length in _LENGTHS:
        stop = np.minimum(np.arange(n) + length, base[of + 1])
        hot = np.flatnonzero(rare[stop] - rare[:-1] >= index.least_rare)
        starts.append(hot)
        stops.append(stop[hot])
    start, stop = np.concatenate(starts), np.concatenate(stops)
    if not len(start):
        return
    need = np.zeros(n + 1, dtype=np.int64)
    np.add.at(need, start, 1)
    np.add.at(need, stop, -1)
    need = np.cumsum(need)[:-1] > 0
    number = np.cumsum(need) - 1
    use = need[block]
    rows, which = number[block[use]], term[use]
    latent = np.zeros((int(need.sum()), index.folding.shape[1]), np.float32)
    cut = np.flatnonzero(np.diff(rows, prepend=-1))
    sizes = np.diff(np.append(cut, len(rows)))
    for k in range(_STRIDE):  # the k-th known term of every block at once
        have = cut[sizes > k]
        latent[rows[have]] += index.folding[which[have + k]]
    for k in range(0, len(start), 8192):
        a, b = start[k : k + 8192], stop[k : k + 8192]
        total = latent[number[a]]
        for step in range(1, max(_LENGTHS)):
            more = np.flatnonzero(a + step < b)
            total[more] += latent[number[a[more] + step]]
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        near = total @ index.passages.T
        for w, p in zip(*np.nonzero(near >= cosine), strict=True):
            row = int(of[a[w]])
            yield row, int(p), (int(a[w]) - int(base[row])) * _STRIDE, (int(b[w]) - int(base[row])) * _STRIDE, float(near[w, p])


def _search(index: Index, column: pa.Array, cosine: float, lcs: float, paraphrase: float) -> Iterator[tuple]:
    """(row, item, cosine, lcs share, answer found, start) of every match in a batch of texts."""
    hashes, first = _terms(column)
    at, term = index.vocabulary.place(hashes)
    if not len(at) or not len(index.items):
        return
    doc = np.searchsorted(first, at, side="right") - 1
    hits: dict[tuple[int, int], list[tuple[float, int, int, int]]] = {}
    for row, p, a, b, near in _near(index, at, term, first, doc, cosine):
        hits.setdefault((row, int(index.owner[p])), []).append((-near, a, b, p))
    for row, p, a, b in _exact(index, at, term, first, doc):
        hits.setdefault((row, int(index.owner[p])), []).append((0.0, a, b, p))
    for (row, k), windows in sorted(hits.items()):
        item = index.items[k]
        for closeness, a, b, p in sorted(windows):
            whole = (0, len(item.terms))
            parts = [(index.bounds[p], index.answers[p])] + [(whole, item.answer)] * (index.bounds[p] != whole)
            for (begin, end), answer in parts:
                margin = end - begin
                lo = max(int(first[row]), int(first[row]) + a - margin)
                hi = min(int(first[row + 1]), int(first[row]) + b + margin)
                around = hashes[lo:hi]
                share = common_subsequence(item.terms[begin:end], around) / margin
                answered = bool(np.isin(answer, around).all())
                if share >= (lcs if margin >= 8 else 0.9) or (margin >= 8 and share >= paraphrase and answered):
                    yield row, item.item_id, -closeness or _cosine(index, item.terms[begin:end], around), share, answered, lo - int(first[row])
                    break
            else:
                continue
            break


def matches(docs: DataFrame, index: Index, cosine: float = 0.65, lcs: float = 0.7, paraphrase: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textbuf.pieces(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                rows = [(ids[r], *rest) for r, *rest in _search(held.value, batch.column(1).slice(a, b - a), cosine, lcs, paraphrase)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")])

    return small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(task, MATCHES)


def drop_contaminated(docs: DataFrame, index: Index, cosine: float = 0.65, lcs: float = 0.7, paraphrase: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without any match."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in textbuf.pieces(column):
                bad = {m[0] for m in _search(held.value, column.slice(a, b - a), cosine, lcs, paraphrase)}
                if len(bad) < b - a:
                    yield batch.slice(a, b - a).filter(pa.array([r not in bad for r in range(b - a)]))
        trim()

    return small_batches(docs).mapInArrow(task, docs.schema)
