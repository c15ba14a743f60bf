"""Toxicity of whole texts after a noisy-channel decoding of disguised words.

Disguised stretches (letters among leet signs, letters three times in a row, single letters with
separators between) are decoded: a Viterbi search over the lattice of what each sign may stand for, what
may be a repetition and what may be a dropped separator, under a character trigram model of all texts.
The restored text is scored by a logistic regression over the presence of words and of 5-byte pieces of
words, chosen by their association with the label; its penalty is chosen by folds of the training rows.

What is learned from labels comes from a hash-ordered sample of at most :data:`SAMPLE` labelled rows
(a parameter); the character model is counted over all documents. Labels, language, source and id are
never inputs of a score.

Defined cases: a null or empty text gets the score of a text without features; repeated rows get equal
scores; texts are read whole; several labels of one document count as the largest, null labels as none;
without labels of both kinds every score is the share of toxic labels (0 without any), so 0.5 is not
reached by accident; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_slices
from .textvec import LOWER, SPACE, _powers, column_bytes, span_hashes, words
from .textvec import _BYTE_LOWER as BYTE

_U = np.uint64
SAMPLE = 20_000
FEATURES = 2_000
LEAST_DOCS = 3
#: Of some million features tested, so few chance ones pass this log-likelihood ratio that they carry no weight together.
LEAST_GAIN = 8
#: Penalties of the regression to choose from, by so many folds of the training rows.
PENALTIES, FOLDS = (2e-5, 2e-6, 2e-4, 2e-3), 4
BITS = 22
PIECE = 5
SHARDS = 16
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "€": "e", "(": "c"}
SEPARATORS = " .-_*"
#: Costs, in nats, of a substituted sign, a dropped repetition and a dropped separator.
SUBSTITUTE, REPEAT, DROP = 1.0, 0.5, 0.3
EDGE, OTHER, CLASSES = 0, 27, 28

_LETTER = r"[^\W\d_]"
SPACED = re.compile(rf"(?<!\w)(?:{_LETTER}[ .\-_*]){{2,}}{_LETTER}(?!\w)")  # s t u p i d
BREAKS = frozenset(" \t\n\r\x0b\x0c.,;:_-/\\\"'?)=<>{}[]&%#~^`")
RUN = re.compile("[^" + re.escape("".join(sorted(BREAKS))) + "]+")  # letters, digits and signs in a row
MIXED = re.compile(rf"{_LETTER}[0134567890@$!|+*€(]|[0134567890@$!|+*€(]{_LETTER}|({_LETTER})\1\1")  # 1d10t, stuuupid
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in SIGNS if ord(c) < 128]] = True
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[*(ord(c) for c in SEPARATORS), *range(0x09, 0x0E)]] = True
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0x80:] = OTHER


def _class(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else OTHER if c.isalpha() else EDGE


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Minus log probability of a class after two others, from all texts; sums reach the driver, one a triple."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for part in text_slices(batches):
            raw, off = column_bytes(part.column(0))
            c = np.concatenate([[0], np.insert(_CLASS[raw], off[1:], 0)])
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["triple", "n"])

    n = np.zeros(CLASSES**3)
    for r in docs.select("text").mapInArrow(count, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        n[r["triple"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES) + 0.01
    lower = n.sum(0) / n.sum((0, 2))[:, None]  # backed by the pair before it
    smooth = (n + 2 * lower[None]) / (n.sum(2, keepdims=True) + 2)
    return -np.log(smooth)


def decode(seen: str, cost: list[list[list[float]]]) -> str:
    """The likeliest plain text behind a disguised stretch: exact Viterbi over pairs of classes."""
    text = seen.lower()
    if len(text) != len(seen):
        text = seen
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    before = ""
    for c in text:
        options = [(0.0, c, _class(c))]
        options += [(SUBSTITUTE, x, _class(x)) for x in SIGNS.get(c, "")]
        drop = DROP if c in SEPARATORS else REPEAT if c == before else None
        before = c
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, path) in best.items():
            row = cost[a][b]
            for extra, out, k in options:
                total, state = so_far + extra + row[k], (b, k)
                if state not in after or total < after[state][0]:
                    after[state] = (total, (path, out))
            if drop is not None and ((a, b) not in after or so_far + drop < after[a, b][0]):
                after[a, b] = (so_far + drop, path)
        best = after
    path = min((t + cost[a][b][EDGE], n, p) for n, ((a, b), (t, p)) in enumerate(best.items()))[2]
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def suspects(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may hold mixed or repeated signs, and rows that may hold spaced letters; each by its own bytes alone."""
    none = np.zeros(0, np.int64)
    if len(raw) < 3:
        return none, none
    letter, sign, low = _IS_LETTER[raw], _IS_SIGN[raw], LOWER[raw]
    begins = off[:-1][np.diff(off) > 0]  # where rows begin
    pair = np.zeros(len(raw), bool)
    pair[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    pair[begins] = False
    at = [np.flatnonzero(pair)]
    data = raw.tobytes()
    euro = "€".encode()
    places, i = [], data.find(euro)
    while i >= 0:
        places.append(i)
        i = data.find(euro, i + 1)
    at.append(np.array(places, np.int64))
    for wide in range(1, 5):  # three equal letters of so many bytes
        if len(raw) < 3 * wide:
            break
        same = low[wide:] == low[:-wide]
        three = same[: len(raw) - 3 * wide + 1].copy()
        for k in range(1, 2 * wide):
            three &= same[k : len(three) + k]
        three &= letter[: len(three)] if wide == 1 else raw[: len(three)] >= 0xC0
        start = np.flatnonzero(three)
        row = np.searchsorted(off, start, side="right") - 1
        at.append(start[start + 3 * wide <= off[row + 1]])
    rows = np.unique(np.searchsorted(off, np.concatenate(at), side="right") - 1)
    # by characters, so that a letter of two bytes is one: a letter alone, a separator, a letter alone, a separator, a letter alone
    lead = (raw < 0x80) | (raw >= 0xC0)
    chars = raw[lead]
    spaced = none
    if len(chars) >= 5:
        first = np.concatenate([[0], np.cumsum(lead)])[off]  # each row's first character
        wide, sep = _IS_LETTER[chars], _IS_SEP[chars]
        before, after = np.concatenate([[False], wide[:-1]]), np.concatenate([wide[1:], [False]])
        inner = first[1:-1]
        before[inner[inner < len(chars)]] = False
        after[inner[inner > 0] - 1] = False
        alone = wide & ~before & ~after
        at = np.flatnonzero(alone[:-4] & sep[1:-3] & alone[2:-2] & sep[3:-1] & alone[4:])
        row = np.searchsorted(first, at, side="right") - 1
        spaced = np.unique(row[at + 5 <= first[row + 1]])
    return rows, spaced


class Restorer:
    """Restores texts under a trigram table; decoded stretches are remembered."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        table = cost.tolist()
        self.decoded = lru_cache(1 << 16)(lambda s: decode(s, table))

    def __reduce__(self):
        return Restorer, (self.cost,)

    def text(self, text: str, spaced: bool = True, mixed: bool = True) -> str:
        if spaced:
            text = SPACED.sub(lambda m: self.decoded(m[0]), text)
        out, done = [], 0
        for m in MIXED.finditer(text) if mixed or spaced else ():
            if m.start() < done:
                continue
            start = m.start()
            while start > done and text[start - 1] not in BREAKS:
                start -= 1
            end = RUN.match(text, start).end()
            out += [text[done:start], self.decoded(text[start:end])]
            done = end
        return "".join(out) + text[done:]

    def column(self, col: pa.Array) -> pa.Array:
        mixed, spaced = (set(x.tolist()) for x in suspects(*column_bytes(col)))
        if not mixed and not spaced:
            return col
        texts = col.to_pylist()
        for r in mixed | spaced:
            texts[r] = self.text(texts[r], r in spaced, r in mixed)
        return pa.array(texts, pa.string())


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and byte place of every word, and the same of every piece of a word; numbers are hashed to 2 * 2**BITS."""
    starts, ends = words(raw, off)
    whole = (span_hashes(raw, starts, ends) >> _U(64 - BITS)).astype(np.int32) + np.int32(1 << BITS)
    if len(raw) < PIECE:
        return whole, starts, np.zeros(0, np.int32), np.zeros(0, np.int64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * down[: len(raw)], out=total[1:])
    hashes = total[PIECE:] - total[:-PIECE]
    hashes *= up[: len(hashes)]
    hashes *= _U(0x9E3779B97F4A7C15)
    hashes >>= _U(64 - BITS)
    # a piece lies in one word and one row
    broken = SPACE[raw]
    ok = ~broken[: len(hashes)]
    for k in range(1, PIECE):
        ok &= ~broken[k : len(hashes) + k]
    for cut in off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))].tolist():
        ok[max(0, cut - PIECE + 1) : cut] = False
    return whole, starts, hashes.astype(np.int32), ok


def present_features(raw: np.ndarray, off: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct row * n + number of the chosen features that a column's rows have."""
    whole, starts, pieces, ok = features(raw, off)
    w, p = table[whole], table[pieces]
    at_w = np.flatnonzero(w >= 0)
    at_p = np.flatnonzero((p >= 0) & ok) if len(p) else np.zeros(0, np.int64)
    rows = np.searchsorted(off, np.concatenate([starts[at_w], at_p]), side="right") - 1
    return np.unique(rows * n + np.concatenate([w[at_w], p[at_p]]))


@dataclass
class Model:
    restorer: Restorer
    chosen: np.ndarray  # feature numbers, ascending
    weight: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        col = self.restorer.column(col)
        raw, off = column_bytes(col)
        total = np.full(len(col), self.bias)
        if len(self.chosen) and len(raw):
            pair = present_features(raw, off, self.table(), len(self.chosen))
            total += np.bincount(pair // len(self.chosen), self.weight[pair % len(self.chosen)], minlength=len(col))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.full(2 << BITS, -1, np.int16)
            self._table[self.chosen] = np.arange(len(self.chosen))
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


def _gain(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's presence and the label."""
    def h(k, n):
        p = np.clip(k / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    return h(k1, n1) + h(k0, n0) - h(k1 + k0, n1 + n0)


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, weight: np.ndarray, penalty: float = 2e-5, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression of sparse 0/1 features, by accelerated gradient steps with a bound of each feature's curvature; row i counts ``weight[i]`` times."""
    n = len(y)
    share = weight / weight.sum()
    mean = float(share @ y)
    w, bias = np.zeros(n_features), float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    size = np.bincount(rows, minlength=n) + 1.0
    rate = 1 / (np.bincount(cols, (size * share)[rows], minlength=n_features) / 4 + penalty)
    bias_rate = 4 / float(share @ size)
    v, vb = w.copy(), bias
    for k in range(steps):
        g = share * (1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols], minlength=n) + vb, -50, 50))) - y)
        nw = v - rate * (np.bincount(cols, g[rows], minlength=n_features) + penalty * v)
        nb = vb - bias_rate * g.sum()
        push = k / (k + 3)
        v, vb = nw + push * (nw - w), nb + push * (nb - bias)
        w, bias = nw, nb
    return w, bias


def choose_penalty(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, weight: np.ndarray, fold: np.ndarray) -> float:
    """The penalty of :data:`PENALTIES` with the least log loss on folds left out of the fit, all of them training rows."""
    loss = np.zeros(len(PENALTIES))
    for k in np.unique(fold).tolist():
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(train) or not 0 < (weight[train] @ y[train]) < weight[train].sum():
            continue
        place = np.full(len(y), -1)
        place[train] = np.arange(len(train))
        own = place[rows] >= 0
        for i, penalty in enumerate(PENALTIES):
            w, bias = fit(place[rows[own]], cols[own], y[train], n_features, weight[train], penalty, 200)
            z = (np.bincount(rows, w[cols], minlength=len(y)) + bias)[test]
            loss[i] += weight[test] @ (np.logaddexp(0, z) - y[test] * z)
    return PENALTIES[int(np.argmin(loss))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Character model from all of ``docs``; classifier from at most ``sample`` labelled rows outside the held-out fold."""
    restorer = Restorer(count_trigrams(docs))
    marked = (
        labels.where(F.col("toxic").isNotNull() & (held_out(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    taken = [(r["doc_id"], r["toxic"]) for r in marked.collect()]  # at most ``sample`` pairs
    spark = docs.sparkSession
    n1 = sum(t for _, t in taken)
    n0 = len(taken) - n1
    if not n1 or not n0:
        share = n1 / len(taken) if taken else 0.0
        return Model(restorer, np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    chosen_ids = spark.createDataFrame(taken, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int32)]  # feature and label, ascending, and rows that have it

        def add(parts: list[np.ndarray]) -> list[np.ndarray]:
            keys = np.concatenate([held[0], *parts])
            n = np.concatenate([held[1], np.ones(len(keys) - len(held[0]), np.int32)])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=-1))
            return [keys[order][first], np.add.reduceat(n[order], first, dtype=np.int32) if len(first) else n]

        new: list[np.ndarray] = []
        for part in text_slices(batches):
            col, y = restorer.column(part.column(0)), part.column(1).to_numpy()
            raw, off = column_bytes(col)
            whole, starts, pieces, ok = features(raw, off)
            at = np.flatnonzero(ok)
            rows = np.searchsorted(off, np.concatenate([starts, at]), side="right") - 1
            pair = np.unique(rows * (2 << BITS) + np.concatenate([whole, pieces[at]]))
            new.append(((pair & ((2 << BITS) - 1)) * 2 + y[pair >> (BITS + 1)]).astype(np.int32))
            if sum(map(len, new)) > max(1 << 20, len(held[0])):
                held, new = add(new), []
        held = add(new)
        cut = np.searchsorted(held[0], np.arange(SHARDS + 1) * 2 * ((2 << BITS) // SHARDS))
        for s in range(SHARDS):
            keys, n = held[0][cut[s] : cut[s + 1]], held[1][cut[s] : cut[s + 1]]
            if len(keys):
                blob = np.concatenate([keys, n])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pa.compress(blob, "zstd", asbytes=True)], pa.binary()), pa.array([blob.nbytes], pa.int64())], names=["shard", "counts", "size"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {}
        for b in batches:
            for s, blob, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                keys, count_of = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.int32).reshape(2, -1)
                sums = n.setdefault(s, np.zeros((2, (2 << BITS) // SHARDS), np.int32))
                sums[keys & 1, (keys >> 1) - s * ((2 << BITS) // SHARDS)] += count_of  # a blob has a key once
        for s, (k0, k1) in n.items():
            gain = np.where(k1 + k0 >= LEAST_DOCS, _gain(k1.astype(float), k0.astype(float), n1, n0), 0)
            top = np.argsort(-gain, kind="stable")[:FEATURES]
            top = top[gain[top] > LEAST_GAIN]
            yield pa.RecordBatch.from_arrays([pa.array(top + s * ((2 << BITS) // SHARDS)), pa.array(gain[top])], names=["feature", "gain"])

    best = (
        labelled.mapInArrow(count, "shard int, counts binary, size long").repartition(SHARDS, "shard")
        .mapInArrow(choose, "feature long, gain double").orderBy(F.desc("gain"), "feature").limit(FEATURES)
    )
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], np.int64))
    if not len(chosen):
        return Model(restorer, chosen, np.zeros(0), float(np.log(n1 / n0)))
    shape = Model(restorer, chosen, np.zeros(len(chosen)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shape.table()
        for part in text_slices(batches):
            pair = present_features(*column_bytes(restorer.column(part.column(0))), table, len(chosen))
            cut = np.searchsorted(pair // len(chosen), np.arange(part.num_rows + 1))
            has = [(pair[cut[i] : cut[i + 1]] % len(chosen)).astype(np.int16).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.binary()), part.column(1)], names=["has", "toxic"])

    examples = labelled.mapInArrow(present, "has binary, toxic int").groupBy("has", "toxic").agg(F.count("*").alias("n")).orderBy("has", "toxic").collect()
    # one row a distinct (has, toxic), which counts as often as the sample has it
    cols = [np.frombuffer(e["has"], np.int16).astype(np.int64) for e in examples]
    y, n = (np.array([e[k] for e in examples], float) for k in ("toxic", "n"))
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    fold = np.array([zlib.crc32(e["has"]) % FOLDS for e in examples], np.int64)
    w, bias = fit(rows, flat, y, len(chosen), n, choose_penalty(rows, flat, y, len(chosen), n, fold))
    return Model(restorer, chosen, w, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted added (replacing columns so named)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            s = model.scores(part.column(part.schema.get_field_index("text")).fill_null(""))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([docs.schema[c] for c in keep]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(score, schema)
