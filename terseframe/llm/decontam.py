"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item has a 256-bit SimHash of its weighted five-word shingles, a shingle weighing
log(1 + items / items that have it) over the whole benchmark. A document's windows are as long as an item,
in words, one at each word. A window without any shingle of the benchmark has similarity 0 to all of it, so
of each length of items those windows are fingerprinted that hold a shingle of an item of that length;
their sums of signs roll from window to window. The fingerprint is looked up in an index of sixteen 16-bit
blocks: two fingerprints within :data:`RADIUS` bits differ in some block by RADIUS // 16 bits at most, so
taking all items within that of any block loses none. Items of the window's length in radius are verified
by the exact weighted similarity of shingle sets (Dice, 0.8 or more). At Dice 0.8 about 52 of the 256 bits
differ, with a standard deviation of 6.5, so the radius is four deviations above; for unlike sets it is
128 and 8.

Items are indexed in blocks of at most :data:`BLOCK` in files of the shared folder; a task holds one
block at a time, so memory does not grow with the benchmark.

Defined cases: a null or empty text has no leak; an item of under five words is one shingle of all its
words, found only in documents that are nothing else; an item without words leaks nowhere; a document
shorter than an item is one window; repeated items are each reported; of several places the most similar,
then first, is reported; null ids of documents and items pass through; extra columns are kept by
:func:`clean_documents` and not read by :func:`find_leaks`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, fresh_dir, materialise, read_bytes, scratch, text_slices, write_bytes
from .textvec import column_bytes, mix, row_counts, shingles, span_hashes, words

WIDTH = 5
LEAST = 0.8
BITS, RADIUS = 256, 80
BLOCK = 20_000
#: Bytes of text that a task compares with one block of items before it turns to the next.
TURN = 16 << 20
_U = np.uint64
_SALT = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_EACH = np.arange(64, dtype=np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """Plus or minus one for each of the BITS bits of each hash."""
    bits = (mix(hashes[:, None] ^ _SALT)[:, :, None] >> _EACH) & _U(1)
    return bits.reshape(len(hashes), BITS).astype(np.float64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 16-bit blocks, of sums of signs; a sum of zero (within rounding) gives 0."""
    return np.packbits(sums > 1e-9, axis=1, bitorder="little").view(np.uint16)


class Index:
    """One block of items: their lengths, shingle sets and fingerprints, and the fingerprints' blocks."""

    def __init__(self, ids: list, sizes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, shared: np.ndarray, shared_weight: np.ndarray, rare: float):
        self.ids, self.sizes = ids, sizes  # sizes in words
        # weights of shingles that several items have; of all others it is ``rare``
        self.shared, self.shared_weight, self.rare = shared, shared_weight, rare
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.total = np.array([self.weights(s).sum() for s in self.sets])
        sums = [self.weights(s) @ signs(s) if len(s) else np.zeros(BITS) for s in self.sets]
        self.prints = packed(np.array(sums)) if sums else np.zeros((0, BITS // 16), np.uint16)
        self.blocks = []  # of each block the distinct values and the items of each
        for column in self.prints.T:
            values, of = np.unique(column, return_inverse=True)
            order = np.argsort(of, kind="stable")
            self.blocks.append((values, order, np.searchsorted(of[order], np.arange(len(values) + 1))))
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        size = np.repeat(sizes, [len(s) for s in self.sets]) if self.sets else np.zeros(0, np.int64)
        order = np.lexsort((size, flat))
        flat, size = flat[order], size[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (size[1:] != size[:-1])]) if len(flat) else np.zeros(0, bool)
        self.known, self.lengths = flat[new], size[new]  # a shingle and each length of items that have it
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known & _U((1 << 20) - 1)).astype(np.int64)] = True

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
        return np.where(self.shared[at] == hashes, self.shared_weight[at], self.rare)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places among ``hashes`` of shingles that some item has."""
        at = np.flatnonzero(self.sieve[(hashes & _U((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        return at[self.known[np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)] == hashes[at]]

    def within(self, print_: np.ndarray) -> np.ndarray:
        """Items whose fingerprints differ by at most RADIUS bits, by way of the blocks."""
        found = np.zeros(len(self.prints), bool)
        for value, (values, order, cut) in zip(print_, self.blocks, strict=True):
            for k in np.flatnonzero(np.bitwise_count(values ^ value) <= RADIUS // (BITS // 16)).tolist():
                found[order[cut[k] : cut[k + 1]]] = True
        items = np.flatnonzero(found)
        return items[np.bitwise_count(self.prints[items] ^ print_).sum(1) <= RADIUS]

    def windows(self, doc: np.ndarray, weight: np.ndarray, many: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of ``many`` shingles at ascending ``starts``; a shingle counts once in a window."""
        first, last = int(starts[0]), int(starts[-1])
        part = slice(first, last + many)
        h, c = doc[part], signs(doc[part]) * weight[part, None]
        order = np.argsort(h, kind="stable")
        before = np.full(len(h), -1)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        before[order[same + 1]] = order[same]
        # a shingle's i-th place is new to the windows that start after its place before and hold place i
        change = np.zeros((len(h) + 1, BITS))
        np.add.at(change, np.maximum(before + 1, np.arange(len(h)) - many + 1).clip(0), c)
        change[1:] -= c
        return packed(np.cumsum(change[: last - first + 1], axis=0)[starts - first])

    def leaks(self, doc: np.ndarray, n_words: int, hit: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """item number -> (similarity, start word, words, distance) of its best window in a document of shingles ``doc``."""
        lo, hi = np.searchsorted(self.known, doc[hit], "left"), np.searchsorted(self.known, doc[hit], "right")
        place = np.repeat(hit, hi - lo)
        length = self.lengths[np.repeat(lo, hi - lo) + np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        weight = self.weights(doc)
        best: dict[int, tuple[float, int, int, int]] = {}
        for size in np.unique(length).tolist():
            many = min(max(1, size - WIDTH + 1), len(doc))
            covered = np.zeros(len(doc) + 1, np.int64)  # windows that hold one of the places
            at = place[length == size]
            np.add.at(covered, np.maximum(at - many + 1, 0), 1)
            np.add.at(covered, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(covered[: len(doc) - many + 1]) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > many) + 1) if len(starts) else ():
                prints, row = np.unique(self.windows(doc, weight, many, run), axis=0, return_inverse=True)
                row = row.ravel()
                for k, print_ in enumerate(prints):
                    items = [i for i in self.within(print_).tolist() if self.sizes[i] == size]
                    for start in run[row == k].tolist() if items else ():
                        own, first = np.unique(doc[start : start + many], return_index=True)
                        w = weight[start : start + many][first]
                        for i in items:
                            total = w.sum() + self.total[i]
                            s = float(2 * w[np.isin(own, self.sets[i], assume_unique=True)].sum() / total) if total else 0.0
                            if s >= LEAST - 1e-12 and (i not in best or (-s, start) < (-best[i][0], best[i][1])):
                                best[i] = (s, start, min(size, n_words), int(np.bitwise_count(self.prints[i] ^ print_).sum()))
        return best


def column_shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, each row's offsets among them, and each row's number of words."""
    raw, off = column_bytes(col)
    starts, ends = words(raw, off)
    bounds = row_counts(starts, off)
    hashes, at = shingles(span_hashes(raw, starts, ends), bounds, WIDTH)
    return hashes, at, np.diff(bounds)


@dataclass
class Benchmark:
    """An indexed benchmark: the files of its blocks and of its weights (none if no items share a shingle), the type of its ids, its items."""

    paths: list[str]
    weights: str | None
    id_type: str
    items: int

    def load(self, path: str) -> Index:
        if path not in _loaded:
            _loaded.clear()  # one block at a time
            rows = pa.ipc.open_file(pa.BufferReader(read_bytes(path))).read_all()
            shared, weight = np.zeros(0, np.uint64), np.zeros(0)
            if self.weights:
                z = pa.ipc.open_file(pa.BufferReader(read_bytes(self.weights))).read_all()
                shared, weight = z.column(0).to_numpy().view(np.uint64), z.column(1).to_numpy()
            lists = rows.column("hashes").combine_chunks()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(lists.values) else np.zeros(0, np.uint64)
            _loaded[path] = Index(rows.column("item_id").to_pylist(), rows.column("size").to_numpy(), hashes, bounds, shared, weight, float(np.log1p(self.items)))
        return _loaded[path]


_loaded: dict[str, Index] = {}


def _to_file(table: pa.Table, path: str) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    write_bytes(path, sink.getvalue())


def build_index(benchmark: DataFrame, block: int = BLOCK) -> Benchmark:
    """Index (item_id, text) in files of the shared folder."""
    with scratch(benchmark.sparkSession) as stay:
        return _build(benchmark, block, stay)


def _build(benchmark: DataFrame, block: int, stay: list[str]) -> Benchmark:
    folder = fresh_dir(benchmark.sparkSession, "decontam")
    stay.append(folder)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            hashes, at, size = column_shingles(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), lists], names=["item_id", "size", "hashes"])

    rows = materialise(items.mapInArrow(cut, f"item_id {kind}, size long, hashes array<long>"), "decontam-items")
    many = rows.count()
    n = max(1, -(-many // block))

    def write_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        of = np.concatenate([b.column(0).to_numpy() for b in parts] or [np.zeros(0, np.int64)]).view(np.uint64)
        df = np.concatenate([b.column(1).to_numpy() for b in parts] or [np.zeros(0, np.int64)])
        order = np.argsort(of)
        path = f"{folder}/{uuid.uuid4().hex}.weights"
        _to_file(pa.table({"hash": of[order].view(np.int64), "weight": np.log1p(many / df[order])}), path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    # only shingles that several items have are listed: all others weigh alike
    several = rows.select(F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    weights = materialise(several.repartition(1).mapInArrow(write_weights, "path string"), "decontam-weights").collect()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            of = b.column(3).to_numpy()
            for k in np.unique(of).tolist():
                held.setdefault(k, []).append(b.filter(pa.array(of == k)).select([0, 1, 2]))
        for parts in held.values():
            path = f"{folder}/{uuid.uuid4().hex}.items"
            _to_file(pa.Table.from_batches(parts).combine_chunks(), path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    dealt = rows.where("size > 0").withColumn("block", F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n)).cast("int"))
    made = materialise(dealt.repartition(n, "block").mapInArrow(write, "path string"), "decontam-blocks")
    return Benchmark(sorted(r["path"] for r in made.collect()), weights[0]["path"] if weights else None, kind, many)


def _leaks_of(col: pa.Array, bench: Benchmark) -> Iterator[tuple[int, object, tuple[float, int, int, int]]]:
    """(row, item id, leak) of a text column."""
    hashes, at, size = column_shingles(col)
    bench.paths.reverse()  # the block in memory comes first
    for path in bench.paths:
        index = bench.load(path)
        hit = index.hits(hashes)
        row = np.searchsorted(at, hit, side="right") - 1
        for r in np.unique(row).tolist():
            for i, leak in index.leaks(hashes[at[r] : at[r + 1]], int(size[r]), hit[row == r] - at[r]).items():
                yield r, index.ids[i], leak


def _slices(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[pa.RecordBatch]:
    return text_slices(batches, most=TURN if len(bench.paths) > 1 else SLICE)


def find_leaks(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """One row a document and item that leaked into it, with the best window."""
    spark_types = docs.sparkSession.createDataFrame([], f"id {bench.id_type}")
    item_type = spark_types.toArrow().schema.field(0).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, bench):
            rows = sorted(_leaks_of(part.column(1), bench), key=lambda x: (x[0], str(x[1])))
            data = [[x[1] for x in rows], *([x[2][k] for x in rows] for k in range(4))]
            types = [item_type, pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            ids = part.column(0).take(pa.array([x[0] for x in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(d, t) for d, t in zip(data, types, strict=True))], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, item_id {bench.id_type}, similarity double, start_word long, n_words long, distance int")


def clean_documents(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark item."""
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, bench):
            keep = np.ones(part.num_rows, bool)
            for r, _, _ in _leaks_of(part.column(at).fill_null(""), bench):
                keep[r] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
