"""Document fingerprints from closed syncmers, and their positional likeness.

A k-mer of characters is an anchor if the smallest hash among its s-mers stands at its first or last
place; that depends on the k-mer alone, so an edit moves only the anchors it touches. One scale serves
texts of all lengths. A fingerprint keeps the anchors whose hash is in the lowest eighth of all hashes, so
it grows with the text, and no fewer than the M smallest; each with the place of its first occurrence. Two
fingerprints are alike by the anchors they share, below the hash up to which both are complete, whose
places differ by about the same offset.

Defined cases: a null text is empty; the empty text's fingerprint is the empty string, like itself
(1.0) and like nothing else (0.0); a text of under k characters has its own hash as an anchor; equal
texts, also repeated rows, have equal fingerprints; rows with equal ids follow each other in text order;
the only row of a table is its own next; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices
from .textvec import _powers, mix

K, S, M = 16, 6, 64
#: 32-bit hashes below it are kept whatever their number.
ALWAYS = 1 << 29
_U = np.uint64


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes and places of its closed syncmers, in text order."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(points)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((points.astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ _U(0xD1B54A32D192ED03)) * down[:n], out=total[1:])

        def grams(at: np.ndarray, width) -> np.ndarray:
            return mix((total[at + width] - total[at]) * up[at])

        chosen = np.zeros(0, np.int64)
        if n >= k:
            small = mix((total[s:] - total[:-s]) * up[: n - s + 1])
            width, least = 1, small
            while width * 2 <= k - s + 1:
                least = np.minimum(least[: len(least) - width], least[width:])
                width *= 2
            if rest := k - s + 1 - width:
                least = np.minimum(least[: len(least) - rest], least[rest:])
            chosen = np.flatnonzero((small[: len(least)] == least) | (small[k - s : k - s + len(least)] == least))
            text_of = np.searchsorted(bounds, chosen, side="right") - 1
            chosen = chosen[chosen + k <= bounds[text_of + 1]]
        hashes = grams(chosen, k) if len(chosen) else np.zeros(0, np.uint64)
        cut = np.searchsorted(chosen, bounds)
        out = []
        for i in range(len(texts)):
            a, b = cut[i], cut[i + 1]
            size = bounds[i + 1] - bounds[i]
            if a < b:
                out.append((hashes[a:b], chosen[a:b] - bounds[i]))
            elif size:  # under k characters: the whole text
                out.append((grams(bounds[i : i + 1], size) ^ _U(int(size)), np.zeros(1, np.int64)))
            else:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def sketch(hashes: np.ndarray, places: np.ndarray, least: int = M) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit anchors below ALWAYS, or the ``least`` smallest if those are more, in ascending order, each at its first place."""
    h, first = np.unique((hashes >> _U(32)).astype(np.int64), return_index=True)
    most = max(least, int(np.searchsorted(h, ALWAYS)))
    return h[:most], places[first[:most]]


def prints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sketch of each text."""
    return [sketch(*x) for x in anchors(texts)]


def encode(h: np.ndarray, p: np.ndarray) -> str:
    return ",".join(f"{a:08x}@{b:x}" for a, b in zip(h.tolist(), p.tolist(), strict=True))


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split("@") for x in text.split(",")] if text else []
    return np.array([int(a, 16) for a, _ in pairs], np.int64), np.array([int(b, 16) for _, b in pairs], np.int64)


def complete_below(h: np.ndarray, least: int = M) -> int:
    """The hash below which a sketch has all anchors of its text."""
    if len(h) < least:
        return 1 << 32
    return ALWAYS if h[-1] < ALWAYS else int(h[-1]) + 1


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Estimated share (Dice) of common anchors that keep about one offset, 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    top = min(complete_below(a[0]), complete_below(b[0]))
    n, m = np.searchsorted(a[0], top), np.searchsorted(b[0], top)
    _, i, j = np.intersect1d(a[0][:n], b[0][:m], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    offset = a[1][i] - b[1][j]
    span = 32 + int(max(a[1].max(), b[1].max())) // 50
    return float(2 * (np.abs(offset - np.median(offset)) <= span).sum() / (n + m))


def _edit(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compare(texts: list[str], following: list[str]) -> list[list]:
    """The columns of OUT for texts and the texts after them; most are both, so each is hashed once."""
    edited = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
    known: dict[str, int] = {}
    for t in [*texts, *following, *edited]:
        known.setdefault(t, len(known))
    made = prints(list(known))
    cols: list[list] = [[] for _ in OUT]
    for t, f, e in zip(texts, following, edited, strict=True):
        a, b, c = made[known[t]], made[known[f]], made[known[e]]
        for col, v in zip(cols, (len(t), hashlib.sha256(e.encode()).hexdigest(), encode(*a), encode(*c), likeness(a, c), likeness(a, b)), strict=True):
            col.append(v)
    return cols


def _ranges(docs: DataFrame, parts: int):
    """Number of the id range a row is in, as a column: about equal ranges, found in two steps of about sqrt(parts) bounds."""
    at = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 20 * parts)).first()[0] if at else None
    cuts = sorted(set(cuts or []))
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] or [[]]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def below(bounds):
        return F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))

    tops = F.array(*[F.lit(g[-1]) for g in groups[:-1]]).cast(f"array<{kind}>")
    inner = F.array(*[F.array(*[F.lit(b) for b in g]).cast(f"array<{kind}>") for g in groups])
    part = F.transform(F.array(below(tops)), lambda t: t * wide + below(F.get(inner, t)))[0]
    return F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its text with the last quarter from the next document, and likenesses.

    Documents are cut into ranges of ids; a task walks a range in order. The first document of each range
    is also sent to the range before it (the first of all to the last), so the texts are shuffled once and
    nothing is kept between jobs. Ids are numbers.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", _ranges(docs, parts))
    # one id a range, so the broadcast has at most as many rows as there are ranges
    heads = texts.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"].alias("_head"))
    heads = heads.withColumnRenamed("part", "_part")
    firsts = texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("part") == F.col("_part"))).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    back = Window.orderBy("part")  # one row a range
    ahead = firsts.select("doc_id", "text", F.coalesce(F.lag("part").over(back), F.max("part").over(Window.partitionBy())).alias("part"), F.lit(True).alias("ahead"))
    rows = texts.withColumn("ahead", F.lit(False)).unionByName(ahead)
    ranged = rows.repartitionById(parts, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for piece in text_slices(batches, most=1 << 20):
            id_type = piece.schema.field(0).type
            ids, texts, range_of, after = (piece.column(i).to_pylist() for i in range(4))
            if held is not None:
                ids, texts, range_of, after = [held[0], *ids], [held[1], *texts], [held[2], *range_of], [held[3], *after]
            held = (ids[-1], texts[-1], range_of[-1], after[-1])
            own = [i for i in range(len(ids) - 1) if not after[i]]
            if own:
                cols = _compare([texts[i] for i in own], [texts[i + 1] for i in own])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], id_type), *(pa.array(c, t) for c, (_, t) in zip(cols, OUT, strict=True))], names=["doc_id", *(c for c, _ in OUT)])

    columns = ", ".join(f"{c} {'long' if t == pa.int64() else 'double' if t == pa.float64() else 'string'}" for c, t in OUT)
    return ranged.mapInArrow(walk, f"doc_id {kind.simpleString()}, {columns}")
