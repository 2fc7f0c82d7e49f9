"""Toxicity by nearest labelled examples.

A bounded, documented sample of the labelled rows (``max_examples`` ids of smallest hash, as long as their
texts together have ``max_chars`` characters at most) is the example set. Texts become TF-IDF vectors over
all terms of the examples, with document frequencies from all documents; every term is weighed by its
association with the label, too (the square of the examples' chi-square statistic, no threshold): long texts
share many words that tell nothing. The ``k`` examples of highest cosine vote with their similarity as weight, and
leave-one-out votes of the examples, made monotone by pooling, turn votes into probabilities.

The search is exact: examples with one heaviest term lie in one block or in neighbouring ones, the index holds
every term's postings by block and its largest weight there, blocks are visited by falling upper bound, and the
visit ends when no bound reaches the k-th best. Ties go to the example of smaller position. A text without any term of the
examples has no neighbour; its vote is the toxic share of examples without one.

Every text is scored whole; scoring reads nothing but the text. The index is bounded by its
parameters, so each task carries it; nothing is shuffled but the labelled rows' ids, the examples, and one
count per task and term.

Defined cases: a null or empty text has no term; repeated rows are scored alike, and of a labelled
id's rows the smallest text is the example; several labels of a document count as toxic if one does;
null labels are no labels; without labelled rows all scores are 0; with labels of one kind only all terms are
weighed alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.store import forget, small_batches, trim, written

_TERM = re.compile(r"[^\W\d_]+")
#: The same for texts below U+0250 alone, with the letters spelled out, which is faster.
_NEAR = re.compile("[" + "".join(chr(c) for c in range(0x250) if _TERM.match(chr(c))) + "]+")
_FAR = re.compile("[^\u0000-\u024f]")
SCORED = "doc_id long, score double, vote double, neighbour_ids array<long>, similarities array<double>"

#: Terms, ascending, and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def terms(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    text = text.lower()
    return (_NEAR if text.isascii() or not _FAR.search(text) else _TERM).findall(text)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


class BlockMaxIndex:
    """Exact k nearest rows by inner product of sparse unit vectors without negative weights.

    A query's terms are looked up heaviest first, in steps. After each, the terms left can add no more to a row than
    their length, nor to a block's rows than its largest weights allow: blocks that can't reach the k best are left
    out, and once few rows can, these are compared with the query exactly.
    """

    _RESTS = (0.4, 0.15, 0.05, 0.02, 0.0)  # lengths left after each step
    _FEW = 100
    _SLACK = 1e-5  # above the rounding of single-precision postings

    def __init__(self, rows: list[Vector], n_terms: int, block: int = 2048):
        self.n = len(rows)
        sizes = np.array([len(t) for t, _ in rows], dtype=np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        self.row_size, self.row_begin = sizes, np.cumsum(sizes) - sizes
        self.row_term, self.row_weight = term.astype(np.int32), weight
        row = np.repeat(np.arange(self.n), sizes)
        heads = [(int(t[np.argmax(w)]), -float(w.max())) if len(t) else (-1, 0.0) for t, w in rows]
        place = np.empty(self.n, dtype=np.int64)
        place[sorted(range(self.n), key=heads.__getitem__)] = np.arange(self.n)
        self.blocks, self.width = max(1, -(-self.n // block)), block
        self.placed = np.argsort(place)  # rows by their place in the blocks
        row = place[row]
        key = term * self.blocks + row // block
        order = np.argsort(key, kind="stable")
        key, row, weight = key[order], row[order].astype(np.int32), weight[order].astype(np.float32)
        self.posts = np.column_stack([row, weight.view(np.int32)])  # the weights' bits, so that a posting lies in one place
        self.begin = np.searchsorted(key, np.arange(n_terms * self.blocks + 1))  # of each term's postings by block
        self.largest = np.zeros(n_terms * self.blocks, np.float32)
        np.maximum.at(self.largest, key, weight)
        self.largest = self.largest.reshape(n_terms, self.blocks)
        self.dense = np.zeros(n_terms)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "dense": len(self.dense)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"dense": np.zeros(state["dense"])}

    def _candidates(self, query: Vector, k: int) -> np.ndarray:
        """All rows that can be among the k best, and few others."""
        by = np.argsort(-query[1], kind="stable")
        term, weight = query[0][by], query[1][by].astype(np.float32)
        left = np.sqrt(np.maximum(0, 1 - np.cumsum(query[1][by] ** 2)))
        left[-1] = 0
        score, least, done = np.zeros(self.blocks * self.width), 0.0, 0
        alive = np.arange(self.blocks)
        for rest in self._RESTS:
            upto = int(np.argmax(left <= rest)) + 1 if rest else len(term)
            if upto <= done:
                continue
            now = weight[done:upto]
            if len(alive) == self.blocks:
                begin, end = self.begin[term[done:upto] * self.blocks], self.begin[(term[done:upto] + 1) * self.blocks]
            else:
                key = (term[done:upto, None] * self.blocks + alive).ravel()
                begin, end, now = self.begin[key], self.begin[key + 1], np.repeat(now, len(alive))
            posts = np.concatenate([self.posts[:0], *(self.posts[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True) if i < j)])
            score += np.bincount(posts[:, 0], posts[:, 1].view(np.float32) * np.repeat(now, end - begin), minlength=len(score))
            ahead = score[score > least]  # the k-th largest never falls
            if len(ahead) >= k:
                least = float(np.partition(ahead, -k)[-k])
            done, rest = upto, float(left[upto - 1])
            rows = np.flatnonzero(score >= max(least - rest - self._SLACK, self._SLACK * 1e-9))
            if done == len(term) or (least > rest + self._SLACK and len(rows) <= self._FEW):
                return self.placed[rows]
            reach = score.reshape(self.blocks, -1).max(axis=1) + np.minimum(weight[done:] @ self.largest[term[done:]], rest)
            alive = np.flatnonzero(reach >= least - self._SLACK)
        raise AssertionError("the last step takes all terms")

    def nearest(self, query: Vector, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities (over 0), best first."""
        term, weight = query
        if not len(term) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        rows = self._candidates(query, k)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0)
        sizes = self.row_size[rows]
        at = _spread(self.row_begin[rows], sizes)
        self.dense[term] = weight
        parts = self.dense[self.row_term[at]] * self.row_weight[at]
        self.dense[term] = 0
        scores = np.round(np.add.reduceat(parts, np.cumsum(sizes) - sizes), 12)
        top = np.lexsort((rows, -scores))[:k]
        top = top[scores[top] > 0]
        return rows[top], scores[top]


@dataclass
class Model:
    """What scoring needs; bounded by ``max_examples`` and ``max_chars``."""

    term: dict[str, int]
    idf: np.ndarray
    association: np.ndarray
    ids: list[int | None]
    toxic: np.ndarray
    index: BlockMaxIndex
    k: int
    bare: float
    cuts: np.ndarray
    values: np.ndarray

    def weigh(self, term: np.ndarray, count: np.ndarray) -> Vector:
        weight = (1 + np.log(count)) * self.idf[term] * self.association[term]
        term, weight = term[weight > 0], weight[weight > 0]
        return term, weight / np.sqrt((weight * weight).sum()) if len(weight) else weight

    def vector(self, text: str | None) -> Vector:
        counts = Counter(terms(text))
        term = np.fromiter(map(self.term.get, counts, repeat(-1)), np.int64, len(counts))
        known = np.flatnonzero(term >= 0)
        known = known[np.argsort(term[known])]
        return self.weigh(term[known], np.fromiter(counts.values(), float, len(counts))[known])

    def vote(self, rows: np.ndarray, scores: np.ndarray) -> float:
        return float((scores * self.toxic[rows]).sum() / scores.sum()) if len(rows) else self.bare

    def calibrated(self, vote: float) -> float:
        if not len(self.cuts):
            return 0.0
        return float(np.interp(vote, self.cuts, self.values))

    def scorer(self, evidence: int, max_known: int = 20_000) -> Callable[[str | None], tuple]:
        """Score, vote and evidence of a text; copies are searched once while they are remembered."""
        known: dict[bytes, tuple] = {}

        def of(text: str | None) -> tuple:
            key = blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in known:
                if len(known) >= max_known:
                    known.clear()
                rows, sims = self.index.nearest(self.vector(text), self.k)
                vote = self.vote(rows, sims)
                known[key] = (self.calibrated(vote), vote, [self.ids[r] for r in rows[:evidence].tolist()], sims[:evidence].tolist())
            return known[key]

        return of


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the best rising step function of y over x, one point per distinct x."""
    x, back = np.unique(np.round(x, 9), return_inverse=True)
    w = np.bincount(back).astype(float)
    y = np.bincount(back, weights=y) / w
    pool: list[list[float]] = []
    for yi, wi in zip(y.tolist(), w.tolist(), strict=True):
        pool.append([yi, wi, 1])
        while len(pool) > 1 and pool[-2][0] >= pool[-1][0]:
            b, a = pool.pop(), pool.pop()
            pool.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return x, np.concatenate([np.full(int(n), v) for v, _, n in pool])


def fit_examples(
    examples: Iterable[tuple[int | None, str | None, int]], k: int = 15, block: int = 2048, frequencies: Callable[[list[str]], tuple[np.ndarray, int]] | None = None
) -> Model:
    """Weigh the terms, index the examples, and calibrate on their leave-one-out votes. ``frequencies``: in how many
    documents each term occurs, and of how many; else the examples' own. No two texts need be held at a time."""
    term: dict[str, int] = {}
    ids, marks, counted = [], [], []
    for doc_id, text, label in examples:
        found = sorted((term.setdefault(w, len(term)), c) for w, c in Counter(terms(text)).items())
        counted.append((np.array([t for t, _ in found], dtype=np.int32), np.array([c for _, c in found], dtype=np.int32)))
        ids.append(doc_id)
        marks.append(label)
    toxic = np.array(marks, dtype=float)
    n, positive = len(ids), float(toxic.sum())
    each = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in counted)])
    seen = np.bincount(each, minlength=len(term)).astype(float)
    if 0 < positive < n:
        hits = np.bincount(each, np.repeat(toxic, [len(t) for t, _ in counted]), minlength=len(term))
        rest = seen - hits
        margins = seen * (n - seen) * positive * (n - positive)
        association = (hits * (n - positive - rest) - rest * (positive - hits)) ** 4 / np.maximum(margins, 1) ** 2
    else:
        association = np.ones(len(term))
    counts, total = frequencies(list(term)) if frequencies and term else (seen, n)
    idf = np.log((1 + total) / (1 + counts)) + 1
    model = Model(term, idf, association, ids, toxic, BlockMaxIndex([], 0), k, 0.0, np.zeros(0), np.zeros(0))
    rows = [model.weigh(t, c) for t, c in counted]
    model.index = BlockMaxIndex(rows, len(term), block)
    bare = np.array([not len(t) for t, _ in rows], dtype=bool)
    model.bare = float(toxic[bare].mean()) if bare.any() else (positive / n if n else 0.0)
    votes, known = np.zeros(n), {}
    for r, row in enumerate(rows):
        if bare[r]:
            votes[r] = model.bare
            continue
        at = blake2b(row[0].tobytes() + row[1].tobytes(), digest_size=16).digest()
        if at not in known:
            known[at] = model.index.nearest(row, k + 1)
        near, sims = known[at]
        other = near != r
        votes[r] = model.vote(near[other][:k], sims[other][:k])
    if n:
        model.cuts, model.values = _monotone(votes, toxic)
    return model


def document_frequencies(docs: DataFrame, chosen: list[str], text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each of the terms occurs, and how many rows there are."""
    held = docs.sparkSession.sparkContext.broadcast({w: t for t, w in enumerate(chosen)})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        found, total = np.zeros(len(place) + 1, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for t in batch.column(0):
                found[[x for x in map(place.get, set(terms(t.as_py()))) if x is not None]] += 1
        found[-1] = total
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    sums = small_batches(docs).select(docs[text].cast("string").alias("text")).mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(chosen) + 1, np.int64)  # one row per term of the examples, and the total
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    held.destroy()
    return out[:-1], int(out[-1])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, max_examples: int = 8192, max_chars: int = 64_000_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **options
) -> Model:
    """``learn``: over ``doc_id``, which labelled documents may be learnt from. The example set is the
    ``max_examples`` of them with the smallest hash of their id, but for those whose texts would bring the
    total beyond ``max_chars``."""
    marked = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()
    if not chosen:
        return fit_examples([], **options)
    marked = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    one = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    one = written(one, "examples")  # an id's rows may be any number; one text of each
    sizes = one.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fitting, room = [], max_chars
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            fitting.append((r["doc_id"],))
    if len(fitting) < len(sizes):
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id")
    rows = one.orderBy("doc_id").toLocalIterator()  # the examples alone, some at a time
    return fit_examples(((r["doc_id"], r["text"], int(r["toxic"])) for r in rows), frequencies=lambda chosen: document_frequencies(docs, chosen, text), **options)


def score(docs: DataFrame, model: Model, evidence: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, vote and the nearest examples of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer(evidence)
        for batch in batches:
            out = [(d.as_py(), *of(t.as_py())) for d, t in zip(batch.column(0), batch.column(1), strict=True)]
            if out:
                types = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "score", "vote", "neighbour_ids", "similarities"]
                )
        trim()

    return small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(task, SCORED)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer(0)
        for batch in batches:
            good = [of(t.as_py())[0] < threshold for t in batch.column(batch.schema.get_field_index(text))]
            if any(good):
                yield batch.filter(pa.array(good))
        del of
        forget(held)
        trim()

    return small_batches(docs).mapInArrow(task, docs.schema)
