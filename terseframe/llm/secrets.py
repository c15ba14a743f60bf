"""Find secrets: fixed patterns, and character Markov models of random strings against ordinary words.

Two bigram models over 66 character classes are trained on labelled samples from the whole table: the
values of the fixed patterns (random strings, with seeded random ones beside them for tables that have
few) and the ordinary words of 3 to 19 characters, with seeded identifiers. What of a run of the
alphabet of keys lies outside base spans, its best segments are secrets if their log-likelihood ratio
exceeds :data:`LEAST_RATIO` and they have at least :data:`LEAST_DISTINCT` different signs; no other length
is asked for.

Base spans: leftmost non-overlapping matches of each kind, those failing the kind's minimal length
dropped; model spans never replace or shorten them and are left out where they overlap one.

Defined cases: a null or empty text has no spans (empty strings, the digest of the empty string);
repeated rows are scanned alike; texts are scanned whole, whatever their length; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .textvec import LOWER, column_bytes, runs

ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")  # LEAST_DISTINCT signs at least
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_RATIO = 20.0
LEAST_DISTINCT = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1  # class 0: the edge of a run
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CLASS[ord(_c)] = _i + 1
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, unsorted."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a greedy run of a class is the whole run, so the minimal length can stand in the pattern
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _rows(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, at, side="right") - 1


def base_suspects(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of a text column in which a base pattern can occur; the others have no base span for certain."""
    starts, ends = runs(_IS_HEX[raw], off)
    found = [_rows(off, starts[ends - starts >= LEAST["hex"]])]
    low = LOWER[raw].tobytes()
    for key in (*KEYWORDS, b"akia"):
        at, hits = low.find(key), []
        while at >= 0:
            hits.append(at)
            at = low.find(key, at + 1)
        found.append(_rows(off, np.array(hits, np.int64)))
    return np.unique(np.concatenate(found))


def model_suspects(raw: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Rows with a run whose positive ratios add up to more than LEAST_RATIO; in the others no segment can."""
    cls = _CLASS[raw]
    starts, ends = runs(cls > 0, off)
    if not len(starts):
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], cls[:-1]])
    before[starts] = 0
    gain = np.where(cls > 0, np.maximum(ratio[before * N + cls], 0), 0)
    total = np.add.reduceat(gain, starts) + np.maximum(ratio[cls[ends - 1] * N], 0)
    return np.unique(_rows(off, starts[total > LEAST_RATIO]))


def _bigrams(text: bytes) -> np.ndarray:
    c = np.concatenate([[0], _CLASS[np.frombuffer(text, np.uint8)], [0]])
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random_, plain = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
    for part in text_slices(batches):
        col = part.column(0)
        raw, off = column_bytes(col)
        if not len(raw):
            continue
        cls = _CLASS[raw]
        starts, ends = runs(cls > 0, off)
        ordinary = (ends - starts >= 3) & (ends - starts < 20)
        # the ordinary runs one after the other, an edge before each and after the last
        size = ends[ordinary] - starts[ordinary]
        masked = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
        place = np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size)
        at = np.arange(len(place)) - place
        masked[np.arange(len(place)) + np.repeat(np.arange(len(size)), size) + 1] = cls[np.repeat(starts[ordinary], size) + at]
        plain += np.bincount(masked[:-1] * N + masked[1:], minlength=N * N)
        for row in base_suspects(raw, off).tolist():
            text = col[row].as_py()
            for s, e, kind in base_spans(text):
                value = text[s:e] if kind != "assign" else ASSIGN.match(text, s)[1]
                random_ += _bigrams(value.encode())
    at = np.flatnonzero(random_ + plain)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(random_[at]), pa.array(plain[at])], names=["pair", "n_random", "n_plain"])


def _seeded() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros(N * N, np.int64)
    for letters in (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[52:62] + "abcdef"):
        for _ in range(200):
            out += _bigrams("".join(letters[i] for i in rng.integers(0, len(letters), 32)).encode())
    return out


#: Words that seeded ordinary identifiers are made of.
WORDS = "get set user name from data base file path index count total value list item next last first max min key map node tree page text line row table column start end time date year code test config option default current previous request response server client error message result size offset length buffer".split()


def _ordinary() -> np.ndarray:
    """Ordinary identifiers in the usual styles, so that long ones are not judged by prose alone."""
    rng = np.random.Generator(np.random.PCG64(9))
    out = np.zeros(N * N, np.int64)
    for k in range(1200):
        w = [WORDS[i] for i in rng.integers(0, len(WORDS), rng.integers(2, 6))]
        styles = ("_".join(w), "-".join(w), "/".join(w), "_".join(w).upper(), w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "".join(w) + str(rng.integers(0, 100)))
        out += _bigrams(styles[k % len(styles)].encode())
    return out


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of classes, random over ordinary; all that reaches the driver is N * N sums."""
    rows = (
        docs.select("text")
        .mapInArrow(_count, "pair long, n_random long, n_plain long")
        .groupBy("pair")
        .agg(F.sum("n_random").alias("n_random"), F.sum("n_plain").alias("n_plain"))
        .collect()
    )
    random_, plain = _seeded().astype(float), _ordinary().astype(float)
    for r in rows:
        random_[r["pair"]] += r["n_random"]
        plain[r["pair"]] += r["n_plain"]

    def log(counts: np.ndarray) -> np.ndarray:
        m = counts.reshape(N, N)
        single = (m.sum(0) + 0.5) / (m.sum() + 0.5 * N)  # rare pairs fall back to single characters
        return np.log((m + 4 * single) / (m.sum(1, keepdims=True) + 4))

    return (log(random_) - log(plain)).reshape(-1)


def _segments(text: str, start: int, end: int, ratio: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments of the piece [start, end) of a run that the models hold for random, the best first.

    Less than LEAST_DISTINCT signs that a segment leaves at an end of the piece belong to it.
    """
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        if len(set(text[a:b])) < LEAST_DISTINCT:
            continue
        c = np.concatenate([[0], _CLASS[np.frombuffer(text[a:b].encode(), np.uint8)], [0]])
        # one ratio of each sign after the sign before it, and of the end
        upto = np.concatenate([[0], np.cumsum(ratio[c[:-1] * N + c[1:]])])
        gain = upto[1:] - np.minimum.accumulate(upto[:-1])
        last = int(np.argmax(gain))
        if gain[last] <= LEAST_RATIO:
            continue
        first = int(np.argmin(upto[: last + 1]))
        lo, hi = a + first, min(a + last + 1, b)
        lo, hi = a if lo - a < LEAST_DISTINCT else lo, b if b - hi < LEAST_DISTINCT else hi
        if len(set(text[lo:hi])) >= LEAST_DISTINCT:
            yield lo, hi
        todo += [(a, lo), (hi, b)]


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed in :data:`KINDS`."""
    found = base_spans(text)
    taken = sorted((s, e) for s, e, _ in found)
    k = 0
    for m in RUN.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < m.end():
            if taken[i][0] > at:
                found += [(s, e, "markov") for s, e in _segments(text, at, taken[i][0], ratio)]
            at = max(at, taken[i][1])
            i += 1
        if at < m.end():
            found += [(s, e, "markov") for s, e in _segments(text, at, m.end(), ratio)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>, base_end excluded) for every document, by :func:`spans`."""
    ratio = train(docs) if ratio is None else ratio

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in text_slices(batches):
            col = part.column(1)
            out: list[list[dict]] = [[] for _ in range(len(col))]
            raw, off = column_bytes(col)
            for row in np.union1d(base_suspects(raw, off), model_suspects(raw, off, ratio)).tolist():
                out[row] = [{"kind": k, "start": s, "end": e} for s, e, k in spans(col[row].as_py(), ratio)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind_type)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans."""

    def joined(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("markov"))


def redact(text: str, ratio: np.ndarray, mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in spans(text, ratio):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
