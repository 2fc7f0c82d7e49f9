"""Tokens with code-point offsets, windows, and token labels from spans."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.spans import bioes

#: Letters and digits together, any other visible character alone; the same in Java and RE2.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]"


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = TOKEN, surface: bool = True) -> DataFrame:
    """key, token_idx, token (if ``surface``), char_start, char_end. Row-local, linear and without a shuffle: no
    built-in function gives the positions of all matches, so the texts go through Arrow. Each row is a
    text of its own, also where keys repeat or are null; null and empty texts have no token."""
    kind = df.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(pattern)
        for batch in batches:
            at, rows, tokens, held = [], [], [], 0
            for row, body in enumerate(batch.column(1)):
                found = [m.span() for m in match.finditer(body.as_py() or "")]
                if not found:
                    continue
                rows.append((row, len(found)))
                at.append(np.array(found, dtype=np.int64))
                if surface:
                    tokens += match.findall(body.as_py())
                held += len(found)
                if held >= 1 << 17 or row == batch.num_rows - 1:
                    yield _tokens(batch.column(0), rows, at, tokens)
                    at, rows, tokens, held = [], [], [], 0
            if rows:
                yield _tokens(batch.column(0), rows, at, tokens)

    def _tokens(keys: pa.Array, rows: list[tuple[int, int]], at: list[np.ndarray], tokens: list[str]) -> pa.RecordBatch:
        spans = np.concatenate(at)
        n = np.array([n for _, n in rows])
        columns = {
            key: keys.take(pa.array(np.repeat([row for row, _ in rows], n))),
            "token_idx": pa.array(np.arange(len(spans)) - np.repeat(np.cumsum(n) - n, n)),
            **({"token": pa.array(tokens, pa.string())} if surface else {}),
            "char_start": pa.array(spans[:, 0]),
            "char_end": pa.array(spans[:, 1]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"`{key}` {kind}, token_idx long, {'token string, ' if surface else ''}char_start long, char_end long"
    return df.select(key, F.col(text).cast("string").alias(f"{key}_")).mapInArrow(task, schema)


#: Of ``TOKEN``: 1 for bytes of letters and digits, 2 for the first byte of any other visible character, else 0.
_BYTE_KIND = np.array([1 if chr(b).isalnum() and b < 0x80 else 2 if 0x20 < b < 0x80 or b >= 0xC0 else 0 for b in range(256)], dtype=np.uint8)


def token_lengths(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens by ``TOKEN`` each text has (a null one none), and the code points of each, over all texts: found by
    their bytes, all texts at once."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    kind = _BYTE_KIND[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    bounds = ends - ends[0]
    word = kind == 1
    first, last = word.copy(), word.copy()
    inside = word[1:] & word[:-1]
    inside[bounds[(bounds > 0) & (bounds < len(word))] - 1] = False  # a word ends with its text
    first[1:] &= ~inside
    last[:-1] &= ~inside
    begin = np.flatnonzero(first | (kind == 2))
    lengths = np.ones(len(begin), dtype=np.int64)
    lengths[word[begin]] = np.flatnonzero(last) - np.flatnonzero(first) + 1
    return np.diff(np.searchsorted(begin, bounds)), lengths


def tag_tokens(df: DataFrame, spans: dict[str, Column], key: str = "doc_id", text: str = "text", pattern: str = TOKEN, background: bool = True) -> DataFrame:
    """key, token_idx, char_start, char_end and, for each entry of ``spans``, the tokens' tags in a column of its name: a
    token goes to the span it overlaps most (ties: the earlier one), others are background; without ``background``
    only tokens with a tag. Row-local: no token is shuffled. Null and empty texts have no token."""
    names = list(spans)
    sort = lambda s: F.struct(s["span_start"].alias("a"), (s["span_start"] - s["span_end"]).alias("less"), s["label"].alias("label"))
    columns = [F.array_sort(F.transform(c, sort)).alias(f"_{n}") for n, c in spans.items()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(pattern)
        for batch in batches:
            out, held = [], 0
            for row in range(batch.num_rows):
                won = [batch.column(2 + k)[row].as_py() or [] for k in range(len(names))]
                if not (background or any(won)):
                    continue
                at = np.array([m.span() for m in match.finditer(batch.column(1)[row].as_py() or "")], dtype=np.int64).reshape(-1, 2)
                tags = [_tags(at, s) for s in won]
                keep = np.arange(len(at)) if background else np.flatnonzero(np.any([t != "O" for t in tags], axis=0))
                if len(keep):
                    out.append((row, keep, at[keep], [t[keep] for t in tags]))
                    held += len(keep)
                if held >= 1 << 17:
                    yield packed(batch.column(0), out)
                    out, held = [], 0
            if out:
                yield packed(batch.column(0), out)

    def packed(keys: pa.Array, out: list) -> pa.RecordBatch:
        at = np.concatenate([x[2] for x in out])
        place = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
        tags = [pa.array(np.concatenate([x[3][k] for x in out]), pa.string()) for k in range(len(names))]
        made = [keys.take(pa.array(place)), pa.array(np.concatenate([x[1] for x in out])), pa.array(at[:, 0]), pa.array(at[:, 1]), *tags]
        return pa.RecordBatch.from_arrays(made, names=[key, "token_idx", "char_start", "char_end", *names])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, token_idx long, char_start long, char_end long, " + ", ".join(f"`{n}` string" for n in names)
    return df.select(key, F.col(text).cast("string").alias(f"{key}_"), *columns).mapInArrow(task, schema)


def _tags(at: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Tags of tokens at (start, end) by spans that are sorted by start, longest first, then label."""
    most, owner = np.zeros(len(at), np.int64), np.full(len(at), -1)
    for k, s in enumerate(spans):
        a, b = s["a"], s["a"] - s["less"]
        near = slice(np.searchsorted(at[:, 1], a, "right"), np.searchsorted(at[:, 0], b, "left"))
        shared = np.minimum(at[near, 1], b) - np.maximum(at[near, 0], a)
        owner[near] = np.where(shared > most[near], k, owner[near])
        most[near] = np.maximum(shared, most[near])
    tags = np.full(len(at), "O", dtype=object)
    won = np.flatnonzero(owner >= 0)
    won = won[np.argsort(owner[won], kind="stable")]
    of, n = np.unique(owner[won], return_counts=True)
    for k, a, b in zip(of.tolist(), (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True):
        label = spans[k]["label"]
        tags[won[a:b]] = f"I-{label}"
        tags[won[a]], tags[won[b - 1]] = f"B-{label}", f"E-{label}"
        if b - a == 1:
            tags[won[a]] = f"S-{label}"
    return tags


def fragments(tokens: Sequence[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each token's text, and where it stands, when its bytes are decoded one token after the other: a split character
    belongs to the token that ends it, and what never becomes one is replaced."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    parts = [decode(b, k == len(tokens) - 1) for k, b in enumerate(tokens)]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return parts, ends - np.array([len(p) for p in parts], dtype=np.int64), ends


def decoded_text(tokens: Sequence[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of the tokens' bytes and each token's code-point range there, a split character being covered by each of
    its tokens; raises if replaced bytes leave the last token short of the text's end."""
    text = b"".join(tokens).decode("utf-8", "replace")
    stop = np.cumsum(np.array([len(c.encode()) for c in text], dtype=np.int64))
    last = np.cumsum(np.array([len(t) for t in tokens], dtype=np.int64))
    start = np.searchsorted(stop, last - [len(t) for t in tokens], side="right") if len(tokens) else last
    end = np.maximum(start, np.searchsorted(np.concatenate([[0], stop[:-1]]) if len(stop) else stop, last, side="left"))
    if len(end) and end[-1] != len(text):
        raise ValueError(f"the tokens end at {end[-1]}, their text at {len(text)}")
    return text, start, end


def token_fragments(df: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """key, token_idx, fragment, char_start, char_end of each row's ``tokens`` (array of binaries)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts, start, end = fragments(batch.column(1)[row].as_py() or [])
                if parts:
                    made = [pa.repeat(batch.column(0)[row], len(parts)), pa.array(np.arange(len(parts))), pa.array(parts, pa.string()), pa.array(start), pa.array(end)]
                    yield pa.RecordBatch.from_arrays(made, names=[key, "token_idx", "fragment", "char_start", "char_end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens.alias(f"{key}_")).mapInArrow(task, f"`{key}` {kind}, token_idx long, fragment string, char_start long, char_end long")


#: The configuration's names for the context length, the first that is there counts, and the default.
CONTEXT_FIELDS = ("default_n_ctx", "initial_context_length", "max_position_embeddings")
DEFAULT_CONTEXT = 4096


def context_length(config: dict, override: int | None = None, accelerated: bool = False) -> int:
    """Tokens a window holds: the override, else on a CPU the default, else what the configuration says."""
    asked = [override] if override is not None else [config[f] for f in CONTEXT_FIELDS if f in config][:1] if accelerated else []
    size = asked[0] if asked else DEFAULT_CONTEXT
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError(f"a context length is a positive integer, not {size!r}")
    return size


def byte_token_ranges(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token_idx, token_id, char_start, char_end of a byte-level vocabulary file of ranks. A character
    whose bytes fall to several tokens is covered by each of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column(1)[row].as_py() or ""
                ids = encoding.encode_ordinary(body)
                if not ids:
                    continue
                starts, ends = char_ranges([len(encoding.decode_single_token_bytes(i)) for i in ids], body)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[row], n), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    names=[key, "token_idx", "token_id", "char_start", "char_end"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(task, f"{key} {kind}, token_idx long, token_id long, char_start long, char_end long")


def char_ranges(byte_counts: list[int], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code-point range of each token of so many bytes; raises if the bytes aren't the text's."""
    widths = np.array([len(c.encode("utf-8", "surrogatepass")) for c in text], dtype=np.int64)
    stop = np.cumsum(widths)
    last = np.cumsum(byte_counts)
    if len(last) and (not len(stop) or last[-1] > stop[-1]):
        raise ValueError("the tokens' bytes are not the text's")
    first = last - byte_counts
    return np.searchsorted(stop, first, side="right"), np.searchsorted(stop - widths, last, side="left")


def windows(tokens: DataFrame, size: int) -> DataFrame:
    """Tokens with their window: tumbling by index, no overlap."""
    if size <= 0:
        raise ValueError("a window has at least one token")
    return tokens.withColumn("window_id", F.floor(F.col("token_idx") / size).cast("long"))


def window_sizes(tokens: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    return windows(tokens, size).groupBy(key, "window_id").agg(F.count("*").alias("n_tokens"))


def won_tokens(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token_idx, boundary, label of the tokens that a span wins: each goes to the span it overlaps
    most (ties: the earlier one). A span that wins no token vanishes."""
    place = Window.partitionBy(key).orderBy("span_start", F.col("span_start") - F.col("span_end"), "label")
    s = spans.select(key, "label", "span_start", "span_end", F.row_number().over(place).alias("_span"))
    overlap = F.least("char_end", "span_end") - F.greatest("char_start", "span_start")
    hit = tokens.join(s, key).where("char_start < span_end AND span_start < char_end").withColumn("_o", overlap).where("_o > 0")
    best = hit.groupBy(key, "token_idx").agg(F.min(F.struct((-F.col("_o")).alias("o"), "_span", "label")).alias("b")).select(key, "token_idx", "b._span", "b.label")
    own = Window.partitionBy(key, "_span")
    return best.withColumn("boundary", bioes(F.row_number().over(own.orderBy("token_idx")), F.count("*").over(own))).select(key, "token_idx", "boundary", "label")


def label_tokens(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every token with boundary and label; null for background."""
    return tokens.join(won_tokens(tokens, spans, key), [key, "token_idx"], "left")


def tag(boundary: Column, label: Column) -> Column:
    return F.coalesce(F.concat(boundary, F.lit("-"), label), F.lit("O"))
