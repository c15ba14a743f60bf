"""Jaccard self-join of documents on five-word shingles by chosen paths.

Equal texts are one set. Every set has a sketch of :data:`DIMS` min-hash values, its tokens. A run
splits the sets recursively: in a bucket, a set goes to the child of each of its tokens that a hash of
the bucket's path samples, with probability 1 / (LEAST * DIMS); so two sets of similarity LEAST share one
sampled token on average. A path depends on its set alone, so the first :data:`SPLITS` splits are made
where the sketch is, and unlike sets, even those with a common passage, hardly ever meet in a bucket.
Buckets of up to :data:`SMALL` sets are compared by brute force; equal ones of several runs are compared
once. In a larger one every set is compared with up to :data:`PIVOTS` pivots: sets at least :data:`PIVOT`
alike are tied to one, and those at least :data:`LEAVE` alike need not be split further, since by the
triangle inequality of the Jaccard distance whatever is LEAST alike to them is tied to that pivot as well.
The others are split again, until no large bucket is left. There are as many runs as give a pair at the threshold the
expected recall :data:`RECALL` after SPLITS splits; sets that needed more splits get the runs that so
many splits need.

Sketches only propose: all texts of a proposed class are compared exactly, as shingle sets, in blocks
of at most :data:`BLOCK` texts, whose pairs are dealt evenly over the tasks; a class of any size is
verified whole. Links of similarity LEAST or more are counted for every document and joined to classes.
A class of n different texts costs n / BLOCK copies of each, which exact counts of links need.

Defined cases: a null text is empty; equal texts are alike, the empty ones too; a text of under five
words is one shingle of all its words; case of ASCII letters and kind of whitespace do not matter to
shingles; a class is named by its smallest doc_id; repeated rows are copies; ties cannot arise; extra
columns are not read by the join and pass through :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, key_filter, materialise, scratch, text_slices, unused
from .components import connected_components
from .textvec import column_bytes, mix, row_counts, shingles, span_hashes, words

WIDTH = 5
LEAST = 0.8
DIMS = 128
RECALL = 0.999
SMALL = 512
PIVOTS = 8
#: Splits made before buckets are formed.
SPLITS = 3
#: Estimates from sketches: pairs proposed in small buckets (five standard errors below LEAST); ties to a pivot and leaving. What
#: is LEAST alike to a set that is LEAVE - 0.1 alike to the pivot is PIVOT + 0.1 alike to the pivot (two standard errors each).
PROPOSE, PIVOT, LEAVE = 0.62, 0.15, 0.55
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Up to so many large buckets' pivots (2 KB a bucket) are broadcast; beyond, they are joined by shuffle.
BROADCAST_BUCKETS = 4_000
_U = np.uint64
_ODD = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, DIMS, dtype=np.uint64) * _U(2) + _U(1)
_DIM = mix(np.arange(1, DIMS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def lost(n_runs: int, depth: int = SPLITS) -> float:
    """Probability that a pair at the threshold meets in none of ``n_runs`` runs whose buckets are small after ``depth`` splits.

    All runs draw from one pair of sketches, so it is a mean over the number of tokens that the two share.
    """
    total = 0.0
    for same in range(DIMS + 1):
        meet = 1.0
        for _ in range(depth):
            meet = 1 - (1 - meet / (LEAST * DIMS)) ** same
        total += math.comb(DIMS, same) * LEAST**same * (1 - LEAST) ** (DIMS - same) * (1 - meet) ** n_runs
    return total


def runs(recall: float = RECALL, depth: int = SPLITS) -> int:
    """Least number of runs by which a pair at the threshold has met with probability ``recall`` if its buckets need ``depth`` splits."""
    n = 1
    while lost(n, depth) > 1 - recall:
        n += 1
    return n


def min_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit tokens of each set, one a dimension; rows without shingles are zeros."""
    out = np.zeros((len(at) - 1, DIMS), np.uint64)
    rows = np.flatnonzero(np.diff(at))
    if len(rows):
        for d in range(DIMS):
            out[rows, d] = mix(np.minimum.reduceat(hashes * _ODD[d], at[rows]) + _DIM[d])
    return out


def children(path: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every sampled token of each row in the bucket ``path``."""
    with np.errstate(over="ignore"):
        drawn = mix((token.astype(np.uint64) + _DIM) ^ path[:, None])
    row, dim = np.nonzero(drawn < _U(int(2**64 / (LEAST * DIMS))))
    return row, mix(drawn[row, dim] + _U(1))


def first_paths(token: np.ndarray, lo: int, hi: int, splits: int = SPLITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all rows after ``splits`` splits of the runs ``lo`` to ``hi``, by rows; one run is held at a time."""
    rows, paths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in mix(np.arange(lo + 1, hi + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)):
        row, path = np.arange(len(token)), np.full(len(token), start)
        for _ in range(splits):
            of, path = children(path, token[row])
            row = row[of]
        rows.append(row)
        paths.append(path)
    row, path = np.concatenate(rows), np.concatenate(paths)
    order = np.argsort(row, kind="stable")
    return row[order], path[order]


def _sketch_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, DIMS)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of batches sorted by their first ``keys`` columns, one table a group."""
    held: list[pa.RecordBatch] = []
    name = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            this = tuple(c[a] for c in cols)
            if this != name and held:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, group: str, item: str, blocks, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on every pair of blocks of every group of ``rows``.

    ``blocks`` gives the number of blocks of a row's group. A row is sent to each pair that has its block.
    ``work`` gets batches sorted by group, lo and hi, the first three columns, then side (the row's block).
    Pairs are numbered and dealt out in turn, so those of one large group go to all tasks.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rest = [c for c in rows.columns if c != group]
    own = rows.withColumn("_n", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64(item), F.col("_n")).cast("int"))
    sent = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    sent = sent.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))
    number = F.col("lo") * F.col("_n") - (F.col("lo") * (F.col("lo") - 1) / 2).cast("long") + (F.col("hi") - F.col("lo"))
    sent = sent.withColumn("_at", F.pmod(F.xxhash64(group) + number, F.lit(parts)).cast("int"))
    sent = sent.repartitionById(parts, "_at").sortWithinPartitions(group, "lo", "hi", item)
    return sent.select(group, "lo", "hi", "side", *rest).mapInArrow(work, schema)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    near = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the pairs that look alike in each small bucket (bucket, id, sketch)."""
    for t in _groups(batches, 1):
        ids, s = t.column(1).to_numpy(), _sketch_rows(t.column(2))
        alike = np.array([(s == x).sum(1) >= PROPOSE * DIMS for x in s])
        label = forest(alike)
        out = np.flatnonzero(label != np.arange(len(ids)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[label[out]])], names=["a", "b"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of sorted sets of hashes."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    if n <= 6:
        for i in range(n):
            out[i, i] = len(sets[i])
            for j in range(i):
                a, b = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                if len(a):
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = 0
                    out[i, j] = out[j, i] = int((b[at] == a).sum())
        return out
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    row, many = row[order], count[col[order]]
    col = col[order]
    first = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, int((often := np.flatnonzero(count >= 24)).size), 2048):  # frequent shingles: a dense product
        part = often[lo : lo + 2048]
        dense = np.zeros((n, len(part)), np.float32)
        take = np.concatenate([np.arange(first[c], first[c + 1]) for c in part])
        dense[row[take], np.repeat(np.arange(len(part)), count[part])] = 1
        out += (dense @ dense.T).astype(np.int32)
    for c in np.unique(count[count < 24]).tolist():  # rare ones: their pairs
        if c == 1:
            continue
        members = row[many == c].reshape(-1, c)
        for lo in range(0, len(members), max(1, 2_000_000 // (c * c))):
            m = members[lo : lo + max(1, 2_000_000 // (c * c))].astype(np.int64)
            out += np.bincount((m[:, :, None] * n + m[:, None, :]).ravel(), minlength=n * n).reshape(n, n).astype(np.int32)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def text_sets(col) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, off = column_bytes(col)
    starts, ends = words(raw, off)
    hashes, at = shingles(span_hashes(raw, starts, ends), row_counts(starts, off), WIDTH)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, links, label) of the texts of each pair of blocks (class, lo, hi, side, id, copies, text, blocks)."""
    for t in _groups(batches, 3):
        own = np.unique(t.column(4).to_numpy(), return_index=True)[1]  # rows are sorted by id; one may repeat
        if len(own) < 2:
            continue
        t = t.take(pa.array(own)).combine_chunks()
        ids, side, copies = t.column(4).to_numpy(), t.column(3).to_numpy(), t.column(5).to_numpy()
        sets = text_sets(t.column(6).combine_chunks())
        both = intersections(sets)
        size = np.array([len(s) for s in sets])
        union = size[:, None] + size[None, :] - both
        # integers, so that a similarity of exactly LEAST is one on every machine
        alike = (both * 10 >= round(LEAST * 10) * union) & (union > 0)
        alike[np.arange(len(ids)), np.arange(len(ids))] = False
        if t.column(1)[0] != t.column(2)[0]:
            alike &= side[:, None] != side[None, :]
        links = alike @ copies
        label = forest(alike)
        out = np.flatnonzero(links)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(links[out], pa.int64()), pa.array(ids[label[out]])], names=["id", "links", "label"])


def _sketch_column(n_runs: int):
    """Number of shingles, sketch and paths of all runs of rows (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw, off = column_bytes(part.column(2))
            starts, ends = words(raw, off)
            hashes, at = shingles(span_hashes(raw, starts, ends), row_counts(starts, off), WIDTH)
            # 16 bits of a token tell sets apart well enough: unlike ones meet only where SPLITS tokens agree
            tokens = (min_hashes(hashes, at) & _U(0xFFFF)).astype(np.uint16)
            row, path = first_paths(tokens, 0, n_runs)
            bounds = np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(bounds), pa.array(path.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array([x.tobytes() for x in tokens], pa.binary()), paths], names=["doc_id", "key", "n", "sketch", "paths"])

    return run


def _more_runs(lo: int, hi: int):
    """Paths of the runs ``lo`` to ``hi`` of rows (id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, path = first_paths(_sketch_rows(b.column(1)), lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(0).take(pa.array(row))], names=["path", "id"])

    return run


def _spanning(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """As few edges that connect what the edges (a, b) connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b, strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties to pivots (no path) and the paths of what is split further, of rows (path, id, sketch, pivots, pivot_sketches)."""
    for b in batches:
        if not b.num_rows:
            continue
        path, ids, s = b.column(0).to_numpy(), b.column(1).to_numpy(), _sketch_rows(b.column(2))
        leave, ours, theirs = np.zeros(len(ids), bool), [], []
        order = np.argsort(path, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(path[order])) + 1):
            pivots = np.array(b.column(3)[rows[0]].as_py(), np.int64)
            sketches = np.frombuffer(b"".join(b.column(4)[rows[0]].as_py()), np.uint16).reshape(-1, DIMS)
            alike = np.stack([(s[rows] == p).mean(1) for p in sketches])
            leave[rows] = (alike >= LEAVE).any(0)
            at, row = np.nonzero(alike >= PIVOT)
            ours += ids[rows[row]].tolist()
            theirs += pivots[at].tolist()
        ours, theirs = _spanning(ours, theirs)
        left = np.flatnonzero(~leave)
        row, child = children(path[left].view(np.uint64), s[left])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(ours), pa.int64()), pa.array(ours, pa.int64()), pa.array(theirs, pa.int64())], names=["path", "id", "pivot"])
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[left[row]]), pa.nulls(len(row), pa.int64())], names=["path", "id", "pivot"])


def proposals(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between the ids of ``sets`` (id, sketch, paths) that chosen paths bring together and sketches find alike.

    Joins with the table of sets are shuffled at every size, so cost grows in proportion to it.
    """
    ties, buckets = [], []
    sketches = sets.select("id", "sketch")
    rows, done, deepest = sets.select(F.explode("paths").alias("path"), "id"), runs(recall), SPLITS
    while True:
        splits, again = SPLITS, None
        while True:
            sizes = materialise(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "cp-sizes")
            # a small bucket is a short list; those of several runs that hold the same sets are one
            small = sizes.where(F.col("size") <= SMALL).select("path")
            buckets.append(materialise(rows.join(small.hint("merge"), "path").groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct(), "cp-buckets"))
            large = sizes.where(F.col("size") > SMALL).select("path")
            if large.limit(1).count() == 0:
                break
            inside = materialise(rows.join(large, "path"), "cp-inside")
            turn = F.pmod(F.xxhash64("id", "path"), F.lit(PIVOTS))
            drawn = inside.groupBy("path").agg(F.array_compact(F.array(*[F.min(F.when(turn == k, F.col("id"))) for k in range(PIVOTS)])).alias("pivots"))
            pivots = drawn.select("path", F.explode("pivots").alias("id")).join(sketches, "id").groupBy("path").agg(F.collect_list("id").alias("pivots"), F.collect_list("sketch").alias("pivot_sketches"))
            # a set is in few buckets of a level, so its paths are one short row and its sketch travels once
            known = inside.groupBy("id").agg(F.collect_list("path").alias("paths")).join(sketches, "id")
            met = known.select("id", "sketch", F.explode("paths").alias("path")).join(bounded_broadcast(materialise(pivots, "cp-pivots"), BROADCAST_BUCKETS), "path")
            out = materialise(met.select("path", "id", "sketch", "pivots", "pivot_sketches").mapInArrow(_split, "path long, id long, pivot long"), "cp-split")
            ties.append(out.where("path is null and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
            rows = out.where("path is not null").select("path", "id")
            again = rows if again is None else again
            splits += 1
        deepest = max(deepest, splits)
        need = runs(recall, deepest)
        if again is None or need <= done:
            break
        # sets that went on from a large bucket get the runs that their further splits need
        rows = materialise(again.select("id").distinct().join(sketches, "id").mapInArrow(_more_runs(done, need), "path long, id long"), "cp-more")
        done = need
    lists = buckets[0]
    for more in buckets[1:]:
        lists = lists.unionByName(more)
    lists = materialise(lists.distinct().select(F.monotonically_increasing_id().alias("bucket"), "ids"), "cp-lists")
    members = lists.select("bucket", F.explode("ids").alias("id")).join(sketches.hint("merge"), "id").select("bucket", "id", "sketch")
    found = members.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_compare_sketches, "a long, b long")
    for more in ties:
        found = found.unionByName(more)
    return found


def similarity_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Distinct texts (key, class, rep, copies, links, class_id, members): the join's whole result.

    ``key`` is the text's MD5, ``class`` the number of its class, ``rep`` the smallest doc_id of its copies, ``links`` the number of
    documents with a different text that are at least LEAST alike, ``members`` the number of documents of the class.
    """
    spark = docs.sparkSession
    with scratch(spark) as stay:
        text = F.coalesce(F.col("text"), F.lit(""))
        keyed = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        drawn = keyed.mapInArrow(_sketch_column(runs(recall)), f"doc_id {kind}, key binary, n long, sketch binary, paths array<bigint>")
        drawn = drawn.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        sets = materialise(drawn.select(F.monotonically_increasing_id().alias("id"), "*"), "cp-sets")
        proposed = connected_components(proposals(sets.where("n > 0"), recall))
        members = materialise(proposed.select(F.col("node").alias("id"), F.col("label").alias("class")).join(sets.select("id", "key", "rep", "copies", "n").hint("merge"), "id"), "cp-members")
        sizes = materialise(members.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")), "cp-classes")
        placed = materialise(members.join(sizes, "class").select("class", "id", "key", "rep", "copies", "blocks"), "cp-placed")
        # only texts that may be some class's are shuffled
        asked = key_filter(placed.select(F.xxhash64("key", "rep").alias("key")), placed.count())
        whole = keyed.where(asked(F.xxhash64("key", "doc_id"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "text")
        texts = placed.join(whole.hint("merge"), (F.col("key") == F.col("_key")) & F.col("rep").eqNullSafe(F.col("_id"))).select("class", "id", "copies", "text", "blocks")
        verified = materialise(block_pairs(texts, "class", "id", F.col("blocks"), _verify, "id long, links long, label long"), "cp-verified")
        links = verified.groupBy("id").agg(F.sum("links").alias("links"))
        joined = connected_components(verified.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
        labels = materialise(joined.withColumnRenamed("node", "id").join(links, "id"), "cp-labels")
        named = sets.select("id", "key", "rep", "copies").join(labels, "id", "left")
        named = materialise(named.select("key", F.coalesce("label", "id").alias("class"), "rep", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("label").isNotNull().alias("tied")), "cp-named")
        # a text without links is a class of its own
        names = named.where("tied").groupBy("class").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("members"))
        shared = named.where("tied").join(names, "class").select("key", "class", "rep", "copies", "links", "class_id", "members")
        alone = named.where("not tied").select("key", "class", "rep", "copies", "links", F.col("rep").alias("class_id"), F.col("copies").alias("members"))
        return materialise(shared.unionByName(alone), "cp-texts", stay)


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of every document; copies of one text are links of each other."""
    texts = similarity_classes(docs)
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("key"))
    return rows.join(texts.select("key", "class_id", "links", "copies").hint("merge"), "key").select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each class: the one with the smallest id, once.

    Filters of bounded size tell most rows that are alone in their class, and most that are not the one to stay; a join
    decides on the others. Rows alone that the first filter takes for members of a class are in that join as well, so a
    full filter costs a larger join and no row.
    """
    texts = similarity_classes(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, plural, chosen, kept_key, kept_rep = (unused(c, docs) for c in ("key_", "plural_", "chosen_", "kept_key_", "kept_rep_"))
    several = texts.where("members > 1").select(F.xxhash64("key").alias("key"))
    in_class = key_filter(several, several.count())
    # two texts of one id can both be the smallest of their class; the smaller digest stays
    first = texts.where((F.col("members") > 1) & F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min(F.struct("key", "rep")).alias("kept")).select("kept.key", "kept.rep")
    mistaken = texts.where("members = 1").where(in_class(F.xxhash64("key"))).select("key", "rep")
    kept = materialise(first.unionByName(mistaken).select(F.col("key").alias(kept_key), F.col("rep").alias(kept_rep)), "cp-kept")
    is_kept = key_filter(kept.select(F.xxhash64(kept_key, kept_rep).alias("key")), kept.count())
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    flagged = keyed.withColumn(plural, in_class(F.xxhash64(key))).withColumn(chosen, is_kept(F.xxhash64(key, "doc_id")))
    asked = flagged.where(F.col(plural) & F.col(chosen))
    same = (F.col(key) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_rep))
    stays = asked.join(kept.hint("merge"), same, "left_semi").dropDuplicates([key, "doc_id"])
    return flagged.where(~F.col(plural)).select(*columns).unionByName(stays.select(*columns))
