"""Greedy longest-match token counts by a linear automaton, without building pieces.

The vocabulary's byte strings form a trie. Every node has a failure link to the node that stands for
what is left after the longest match is popped, and the number of tokens popped on the way; so a word
is read byte by byte, once, and only numbers are added. Links and counts are computed breadth first
from the parent's. All single bytes are in the vocabulary, so every string can be cut.

A document's count is the sum over its words (maximal runs of bytes outside 0x20 and 0x09-0x0D) of
the greedy pieces of the word with one space before it. Words repeat, so a bounded table keeps the
counts of those seen.

Defined cases: a null or empty text has no word and no token; repeated rows give repeated results; an
empty table an empty result; other columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.store import small_batches

_WORD = re.compile("[^\x20\x09-\x0d]+")
_automata: dict[str, Automaton] = {}


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    return [bytes(byte[c] for c in t) for t in data["model"]["vocab"] if t not in special]


class Automaton:
    """Trie with failure links and popped-token counts; node 0 is the empty string."""

    def __init__(self, tokens: Iterable[bytes]):
        tokens = set(tokens) - {b""}
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("the vocabulary must have every single byte")
        self.go: list[dict[int, int]] = [{}]
        whole = [False]
        for t in sorted(tokens):
            at = 0
            for b in t:
                to = self.go[at].get(b)
                if to is None:
                    to = len(self.go)
                    self.go[at][b] = to
                    self.go.append({})
                    whole.append(False)
                at = to
            whole[at] = True
        n = len(self.go)
        self.fail, self.pops, self.finish = [0] * n, [0] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.go[u].items():
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    at, popped = self.fail[u], self.pops[u]
                    while b not in self.go[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    self.fail[v], self.pops[v] = self.go[at][b], popped
                self.finish[v] = self.pops[v] + self.finish[self.fail[v]]

    def count(self, word: bytes) -> int:
        """Greedy pieces of ``word``."""
        go, fail, pops = self.go, self.fail, self.pops
        at = total = 0
        for b in word:
            to = go[at].get(b)
            while to is None:
                total += pops[at]
                at = fail[at]
                to = go[at].get(b)
            at = to
        return total + self.finish[at]


def automaton(path: str) -> Automaton:
    """One per Python worker and vocabulary file."""
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path))
    return _automata[path]


def count_tokens(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", max_words: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocab), {}
        for batch in batches:
            words_of, tokens = [], []
            for at in range(0, batch.num_rows, 512):
                cut = [_WORD.findall(t or "") for t in batch.column(1).slice(at, 512).to_pylist()]
                new = set().union(*cut).difference(known)
                if len(known) + len(new) > max_words:
                    known.clear()
                    new = set().union(*cut)
                for w in new:
                    known[w] = machine.count(b" " + w.encode("utf-8", "surrogatepass"))
                words_of += map(len, cut)
                tokens += [sum(map(known.__getitem__, words)) for words in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    chosen = small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, n_words long, n_tokens long")
