"""Near-duplicate join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes the set of its 5-word windows (A-Z lower-cased; 32-bit hashes), a 128-bit key of
   that set, and ``bands`` hashes of ``rows`` MinHash values each. Both numbers follow from the recall
   asked for at the threshold.
2. Texts with one key are copies: one representative carries their number, so a group of copies costs
   one row, whatever its size.
3. Representatives meet on band hashes. A bucket of more than ``tile`` members is cut into chunks, and
   chunk pairs are tiles; no task gets more than two chunks. A pair is decided in the bucket of its
   first common band only, so nothing is decided twice. Members without such a pair leave before the
   n-gram sets are shipped.
4. Tiles return sums of links and one edge per member to its tile's smallest linked member, never
   pairs. Alternating stars over those edges (their number is linear) give the classes.

Defined cases: a null or empty text has the empty set, and all texts with it are copies of each
other; texts of 1 to 4 words have one window of all words; a null doc_id is carried and doesn't name
a class unless all of it are null; repeated rows are copies; an empty table gives an empty result;
other columns are not read. A 32-bit window hash collides within a pair of 1,000-window texts with a
chance of one in 2,000, and moves the similarity by one window then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import textbuf
from veilspan.llm.store import small_batches, trim, unused, written

SIGNED = "doc_id long, row long, key binary, n long, bands array<long>, grams binary"


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band that reach ``recall`` at ``threshold`` with ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def sign(docs: DataFrame, bands: int, rows: int, words: int = 5, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """The n-gram set, its key and its band hashes, of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        xor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        for batch in batches:
            for a, b in textbuf.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offsets = textbuf.text_bytes(part.column(1))
                starts, ends, first = textbuf.word_bounds(data, offsets)
                hashes, at = textbuf.window_hashes(textbuf.word_hashes(data, starts, ends, lower=True), first, words)
                x = (hashes >> np.uint64(32)).astype(np.uint32)
                n = b - a
                doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
                both = np.unique(doc << np.uint64(32) | x.astype(np.uint64))  # each text's set, sorted
                x = both.astype(np.uint32)
                at = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                edge = at[full]
                sig = np.zeros((n, bands), dtype=np.uint64)
                keys = np.zeros((n, 2), dtype=np.uint64)
                if len(full):
                    for k in range(bands * rows):
                        low = np.minimum.reduceat((x ^ xor[k]) * mul[k], edge)
                        band = k // rows
                        sig[full, band] = textbuf.mix(sig[full, band] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(k + 1))
                    wide = textbuf.mix(x.astype(np.uint64) + np.uint64(1))
                    keys[full, 0] = np.add.reduceat(wide, edge)
                    keys[full, 1] = np.add.reduceat(textbuf.mix(wide ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edge)
                raw = pa.py_buffer(x.astype("<u4").tobytes())
                grams = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), raw])
                flat = pa.array(sig.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([keys[k].tobytes() for k in range(n)], pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands), pa.int32()), flat),
                        grams,
                    ],
                    names=["doc_id", "row", "key", "n", "bands", "grams"],
                )
        trim()

    chosen = small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return chosen.withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(task, SIGNED)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows: many small groups at once, none cut in two."""
    held: list[pa.RecordBatch] = []

    def change(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in by:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = change(batch)
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            last = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(t: pa.Table, threshold: float, by: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one tile whose first common band is the tile's, and whose sizes allow the threshold."""
    n = t.num_rows
    col = lambda c: t.column(c).to_numpy()
    tile = np.zeros(n, dtype=np.int64)
    for c in by:
        v = col(c)
        tile[1:] += v[1:] != v[:-1]
    tile = np.cumsum(tile > 0)
    stop = np.searchsorted(tile, tile, side="right")
    chunk, size, band, diagonal = col("chunk"), col("n"), col("band"), col("i") == col("j")
    bands = t.column("bands").combine_chunks()
    width = len(bands.values) // max(n, 1)
    sig = bands.flatten().to_numpy().reshape(n, width)
    row = np.arange(n)
    d = 1
    while True:
        a = row[row + d < stop]
        if not len(a):
            return
        b = a + d
        ok = (diagonal[a] | (chunk[a] != chunk[b])) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        if len(a):
            first = np.argmax(sig[a] == sig[b], axis=1)
            mine = first == band[a]
            if mine.any():
                yield a[mine], b[mine]
        d += 1


_TILE = ["bucket", "i", "j"]


def _useful(threshold: float):
    """Rows of a tile that have a pair to decide there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, _TILE):
            t = t.combine_chunks()
            use = np.zeros(t.num_rows, dtype=bool)
            for a, b in _pairs(t, threshold, _TILE):
                use[a] = use[b] = True
            if use.any():
                yield from t.filter(pa.array(use)).combine_chunks().to_batches()

    return task


def _decide(threshold: float):
    """Links of each row of a tile (in documents) and the smallest key it is linked with."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= threshold * (len(x) + len(y) - both) - 1e-9

    def products(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common windows of the pairs, by products of membership blocks."""
        rows = np.unique(np.concatenate([a, b]))
        place = np.searchsorted(rows, np.arange(int(rows[-1]) + 1))
        owner = np.repeat(np.arange(len(rows)), [len(grams[r]) for r in rows])
        values = np.concatenate([grams[r] for r in rows])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
        common = np.zeros((len(rows), len(rows)), dtype=np.float32)
        step = 4096
        for c in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, [c, c + step])
            member = np.zeros((len(rows), step), dtype=np.float32)
            member[owner[lo:hi], column[lo:hi] - c] = 1
            common += member @ member.T
        return common[place[a], place[b]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, _TILE):
            t = t.combine_chunks()
            found = list(_pairs(t, threshold, _TILE))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            raw = t.column("grams").combine_chunks()
            used = np.unique(np.concatenate([a, b]))
            grams: list = [None] * t.num_rows
            for r in used.tolist():
                grams[r] = np.frombuffer(raw[r].as_buffer(), "<u4")
            bucket = t.column("bucket").to_numpy()
            linked = np.zeros(len(a), dtype=bool)
            order = np.argsort(a, kind="stable")
            key = np.stack([bucket[a], t.column("i").to_numpy()[a], t.column("j").to_numpy()[a]])[:, order]
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                own = order[lo:hi]
                if len(own) > 200:
                    x, y = a[own], b[own]
                    common = products(grams, x, y)
                    size = np.array([len(g) if g is not None else 0 for g in grams])
                    linked[own] = common >= threshold * (size[x] + size[y] - common) - 1e-6
                else:
                    for k in own.tolist():
                        linked[k] = similar(grams[a[k]], grams[b[k]])
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            copies, keys = t.column("copies").to_numpy(), t.column("key").to_pylist()
            links = np.zeros(t.num_rows, dtype=np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = list(range(t.num_rows))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    if keys[y] < keys[x]:
                        x, y = y, x
                    root[y] = x
            rows = np.unique(np.concatenate([a, b])).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[r] for r in rows], pa.binary()), pa.array(links[rows]), pa.array([keys[find(r)] for r in rows], pa.binary())],
                names=["key", "links", "root"],
            )

    return task


def classes_of(edges: DataFrame) -> DataFrame:
    """key, root (the class's smallest key) for all keys of ``edges`` (key, root), by alternating stars."""
    edges = written(edges.where("key <> root").select(F.greatest("key", "root").alias("u"), F.least("key", "root").alias("v")).distinct(), "near-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "near-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = written(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "near-small")
        edges = small
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            # No root is a member of another star, so every member has one edge, to its root.
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))


def near_classes(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, words: int = 5, tile: int = 256, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, row (a hash of id and text), class_id (smallest doc_id of the class), n_links, n_windows,
    class_key; one row per document."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(sign(docs, bands, rows, words, doc_id, text), "near-signed")
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    reps = written(reps, "near-reps")
    spread = reps.where("n > 0").select("key", F.posexplode("bands").alias("band", "_hash")).select("key", "band", F.xxhash64("band", "_hash").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("_m")).where("_m > 1")
    # Only members of shared buckets get their sizes and band hashes back.
    members = spread.join(sizes, "bucket").join(reps.select("key", "n", "copies", "bands"), "key").withColumn("_c", F.ceil(F.col("_m") / tile).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("_c")).cast("int"))
    tiles = members.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).select(
        "bucket", F.least("chunk", "_j").alias("i"), F.greatest("chunk", "_j").alias("j"), "band", "chunk", "key", "n", "copies", "bands"
    )
    schema = "bucket long, i int, j int, band int, chunk int, key binary, n long, copies long, bands array<long>"
    grouped = lambda df: df.repartition(*[F.col(c) for c in _TILE]).sortWithinPartitions(*_TILE, "key")
    useful = written(grouped(tiles).mapInArrow(_useful(threshold), schema), "near-tiles")
    grams = signed.join(useful.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.any_value("grams").alias("grams"))
    decided = grouped(useful.join(grams, "key")).mapInArrow(_decide(threshold), "key binary, links long, root binary")
    decided = written(decided, "near-decided")
    links = decided.groupBy("key").agg(F.sum("links").alias("links"))
    classed = reps.select("key", "first_id", "copies").join(links, "key", "left").join(classes_of(decided.select("key", "root")), "key", "left")
    classed = written(classed.select("key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("class_key")), "near-classes")
    named = classed.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    found = classed.join(named, "class_key").select("key", "class_id", "n_links", "class_key")
    # One row per key here against all its copies: AQE splits a key with many.
    return signed.select("doc_id", "row", "key", "n").join(found, "key").select("doc_id", "row", "class_id", "n_links", F.col("n").alias("n_windows"), "class_key")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One whole row of ``docs`` per class: that of the smallest id (ids before null), then of the smaller
    hash of its text; of rows with the same id and text any one."""
    known = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    first = near_classes(docs, doc_id=doc_id, text=text, **options).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f"))
    id_, row = unused(docs.columns, "id", "row")
    first = written(first.select(known(F.col("f.doc_id")).alias(id_), F.col("f.row").alias(row)), "near-first")
    marked = docs.withColumn(id_, known(docs[doc_id])).withColumn(row, F.xxhash64(docs[doc_id].cast("long"), docs[text].cast("string")))
    return marked.join(first, [id_, row], "left_semi").dropDuplicates([id_, row]).select(*docs.columns)
