"""A trigram language model in Elias-Fano tries, trained and queried by Spark tasks.

Words are numbered by the rank of their 64-bit hashes. A trie holds, for the pairs of first and second
word of its range, three levels: pointers of each word to its successors' place (monotone, Elias-Fano),
the successors themselves (made monotone by adding the end of the context before, Elias-Fano), and the
same again for the third words of each pair, beside probabilities quantised to 16 bits on one fixed log
scale. A query finds a word among its context's successors: two pointers give the range, a successor
search the place. Queries of a slice of texts are distinct and sorted, so they walk the levels in order.

Smoothing is interpolated modified absolute discounting: level k adds its discounted share (alpha) to
gamma(context) times the level below; the lowest is (c + 0.5) / (N + 0.5 (V + 1)), which keeps a share for
unknown words. All n-grams of the training texts are in the model, none is pruned. Discounts come from the
counts of counts of the whole corpus, so a trie is built in two steps: levels and counts first, and its
probabilities when all tries' counts are known.

There is a trie for every :data:`TRIE_TOKENS` tokens, whatever the number of partitions: one corpus has one
model. Ranges of pairs are cut so that each gets about as many tokens, by the product of the words'
frequencies; so a frequent first word is spread over several tries, and its gamma is the sum
over them. Vocabulary and tries are files of the shared folder that every task maps into memory; a
lookup touches a few pages. Tables between jobs are written, so a lost executor costs its tasks alone.

Defined cases: a null or empty text is the end token alone; without training texts every token has
probability 1; repeated rows are scored alike; words are hashed to 64 bits (two of V words share a hash
with probability of about V * V / 2**65); extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, held_out, materialise, scratch, text_slices
from .eliasfano import EliasFano, dump, open_mapped
from .textvec import column_bytes, mix, row_counts, span_hashes, words

_U = np.uint64
END = mix(np.array([0x5EED], np.uint64))[0]
#: Tokens gathered by a task before it sorts them and sends them off.
FLUSH = 1_500_000
SLICE, SCORED = 1 << 20, 4 << 20
#: Training tokens of one trie.
TRIE_TOKENS = 2_000_000
#: Probabilities down to 10 ** LOWEST have codes.
LOWEST = -12.0


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a text column, an end after each row, and the rows' offsets among them."""
    raw, off = column_bytes(col)
    starts, ends = words(raw, off)
    bounds = row_counts(starts, off)
    out_at = bounds + np.arange(len(bounds))
    out = np.full(int(out_at[-1]), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[out_at[1:] - 1] = False
    out[inner] = span_hashes(raw, starts, ends)
    return out, out_at


def _send(shard: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    shape = json.dumps([[len(a), a.dtype.str] for a in arrays])
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([shape]), pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], names=["shard", "shape", "size", "run"])


RUN = "shard int, shape string, size long, run binary"


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """(shard, its runs) of rows sorted by shard."""
    held, name = [], None
    for b in batches:
        for shard, shape, size, run in zip(*(b.column(i) for i in range(4)), strict=True):
            shard = shard.as_py()
            if shard != name and held:
                yield name, held
                held = []
            name = shard
            data, at, arrays = pa.decompress(run.as_py(), size.as_py(), "zstd", asbytes=True), 0, []
            for n, kind in json.loads(shape.as_py()):
                arrays.append(np.frombuffer(data, np.dtype(kind), n, at))
                at += n * np.dtype(kind).itemsize
            held.append(arrays)
    if held:
        yield name, held


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


class Vocabulary:
    """Ids and counts of word hashes, over mapped files cut by ranges of hashes."""

    def __init__(self, manifest: list[tuple[str, int, int]], shards: int):
        self.manifest, self.shards = manifest, shards  # by shard: path or '', words, tokens
        self.first_id = np.concatenate([[0], np.cumsum([m[1] for m in manifest])]).astype(np.int64)
        self.first_cum = np.concatenate([[0], np.cumsum([m[2] for m in manifest])]).astype(np.int64)
        self.size, self.total = int(self.first_id[-1]), int(self.first_cum[-1])
        self.open: dict[int, dict] = {}

    def __reduce__(self):
        return Vocabulary, (self.manifest, self.shards)

    def part(self, s: int) -> dict:
        if s not in self.open:
            self.open[s] = open_mapped(self.manifest[s][0])
        return self.open[s]

    def _counts(self, s: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.part(s)["ends"]
        before, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        head = at == 0
        end[head] = ends.access(at[head]).astype(np.int64)
        before[~head], end[~head] = (x.astype(np.int64) for x in ends.access_pairs(at[~head] - 1))
        return end - before, before + self.first_cum[s]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens of all smaller ids) of sorted distinct hashes."""
        ids, n, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(_shard_of_hash(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cut[s], cut[s + 1]
            if a == b or not self.manifest[s][1]:
                continue
            at = self.part(s)["hashes"].find(hashes[a:b])
            known = np.flatnonzero(at >= 0)
            ids[a + known] = at[known] + self.first_id[s]
            n[a + known], before[a + known] = self._counts(s, at[known])
        return ids, n, before

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.first_id)
        for s in range(self.shards):
            if cut[s] < cut[s + 1]:
                out[cut[s] : cut[s + 1]] = self._counts(s, ids[cut[s] : cut[s + 1]] - self.first_id[s])[0]
        return out


def _pair_shard(n1, before1, n2, before2, total: int, shards: int) -> np.ndarray:
    """Trie of the pairs of words, from their counts and the tokens of smaller ids; monotone in the pair."""
    share = (before1 + n1 * ((before2 + 0.5 * n2) / total)) / total
    return np.minimum((share * shards).astype(np.int64), shards - 1)


def train_vocabulary(train: DataFrame, shards: int) -> Vocabulary:
    folder = fresh_dir(train.sparkSession, "lm-vocabulary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            h, n = _sum_by(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            cut = np.searchsorted(_shard_of_hash(h, shards), np.arange(shards + 1))
            for s in range(shards):
                if cut[s] < cut[s + 1]:
                    yield _send(s, [h[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]].astype(np.uint32)])

        for part in text_slices(batches, most=SLICE):
            held.append(np.unique(tokens(part.column(0))[0], return_counts=True))
            if sum(len(h) for h, _ in held) > FLUSH:
                held = [_sum_by(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                if len(held[0][0]) > FLUSH:
                    yield from sent()
                    held = []
        if held:
            yield from sent()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, runs in _receive(batches):
            h, n = _sum_by(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]).astype(np.int64))
            path = f"{folder}/{s}-{np.random.default_rng().integers(1 << 62):x}.words"
            dump(path, {"hashes": EliasFano.build(h), "ends": EliasFano.build(np.cumsum(n).astype(np.uint64))})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path]), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "path", "words", "tokens"])

    runs = train.select("text").mapInArrow(count, RUN).repartitionById(shards, "shard").sortWithinPartitions("shard")
    made = {r["shard"]: (r["path"], r["words"], r["tokens"]) for r in materialise(runs.mapInArrow(write, "shard int, path string, words long, tokens long"), "lm-words").collect()}
    return Vocabulary([made.get(s, ("", 0, 0)) for s in range(shards)], shards)


def _numbered(col: pa.Array, vocabulary: Vocabulary):
    """Tokens of a column as places in its distinct words, the words' (id, count, before), and row offsets."""
    h, at = tokens(col)
    distinct, place = np.unique(h, return_inverse=True)
    return place, *vocabulary.lookup(distinct), at


def _order(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their columns, and where in it a new row begins."""
    if not len(cols[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = [int(c.min()) for c in cols]
    wide = [(int(c.max()) - x).bit_length() for c, x in zip(cols, low, strict=True)]
    if sum(wide) > 64:  # numbers within the rows at hand take fewer bits
        cols = [np.unique(c, return_inverse=True)[1] for c in cols]
        low, wide = [0] * len(cols), [int(c.max()).bit_length() for c in cols]
    if sum(wide) > 64:
        order = np.lexsort(cols[::-1])
        return order, np.flatnonzero(np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)]))
    key = np.zeros(len(cols[0]), np.uint64)
    for c, x, w in zip(cols, low, wide, strict=True):
        key = (key << _U(w)) | (c - c.dtype.type(x)).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def counts_of_counts(n: np.ndarray) -> list[int]:
    """How many n-grams occur once, twice, three and four times."""
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


def discounts(c: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts (modified absolute discounting)."""
    if not c[0] or not c[1]:
        return np.array([0.5, 0.75, 0.9])
    y = c[0] / (c[0] + 2 * c[1])
    d = np.array([1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2] if c[2] else 1.5])
    return np.clip(d, 0.05, [0.95, 1.9, 2.85])


def quantised(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] to 16 bits, evenly on a log scale; 0 becomes the smallest."""
    return np.round(np.clip(np.log10(np.maximum(x, 10**LOWEST)) / LOWEST, 0, 1) * 65535).astype(np.uint16)


def _value(codes: np.ndarray) -> np.ndarray:
    return 10 ** (codes.astype(np.float64) * (LOWEST / 65535))


def _relative(ids: np.ndarray, bounds: np.ndarray) -> EliasFano:
    """Ids ascending within each context, made one monotone sequence by adding the end of the context before."""
    filled = np.flatnonzero(np.diff(bounds))
    last = np.zeros(len(bounds) - 1, np.uint64)
    last[filled] = ids[bounds[filled + 1] - 1] + _U(1)
    base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)])[:-1]
    return EliasFano.build(ids + np.repeat(base, np.diff(bounds)))


def _child(level: EliasFano, pointers: EliasFano, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of ``word`` among its context's successors or -1, whether the context has any), of ascending contexts and known words."""
    if not len(context):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = np.concatenate([[True], context[1:] != context[:-1]])
    lo, hi = (x.astype(np.int64) for x in pointers.access_pairs(context[new]))
    base = np.zeros(len(lo), np.uint64)
    some = np.flatnonzero((hi > lo) & (lo > 0))
    base[some] = level.access(lo[some] - 1) + _U(1)
    of = np.cumsum(new) - 1
    out = np.full(len(context), -1, np.int64)
    asked = np.flatnonzero((hi > lo)[of])
    own = of[asked]
    out[asked] = level.find(base[own] + word[asked].astype(np.uint64), lo[own], hi[own])
    return out, (hi > lo)[of]


def build_levels(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> tuple[dict, list[np.ndarray]]:
    """Levels of a trie and its counts, of distinct sorted triples; a third word equal to the vocabulary's size stands for none."""
    new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
    first = np.flatnonzero(new)
    a, b = w1[first].astype(np.int64), w2[first]
    low, high = int(a[0]), int(a[-1])
    bounds2 = np.searchsorted(a, np.arange(low, high + 2))
    third = w3 < _U(vocabulary.size)
    bounds3 = np.searchsorted((np.cumsum(new) - 1)[third], np.arange(len(first) + 1))
    parts = {"low": low, "high": high, "pointers2": EliasFano.build(bounds2.astype(np.uint64)), "words2": _relative(b, bounds2), "pointers3": EliasFano.build(bounds3.astype(np.uint64)), "words3": _relative(w3[third], bounds3)}
    return parts, [np.diff(bounds2), np.diff(bounds3), np.add.reduceat(n, first), n[third]]


def build_probabilities(low: int, counts: list[np.ndarray], vocabulary: Vocabulary, d2: np.ndarray, d3: np.ndarray) -> tuple[dict, dict[int, float]]:
    """Quantised probabilities of a trie's levels, and the discounted mass of its first and last word, whose pairs may be in other tries too."""
    per_word, per_pair, n2, n3 = counts
    pair_of = np.repeat(np.arange(len(n2)), per_pair)
    word_of = np.repeat(np.arange(len(per_word)), per_word)
    taken2, taken3 = d2[np.minimum(n2, 3) - 1], d3[np.minimum(n3, 3) - 1]
    total3 = np.bincount(pair_of, n3, minlength=len(n2))
    used = np.flatnonzero(per_word)
    word_n = np.ones(len(per_word))
    word_n[used] = vocabulary.of_ids(used + low)
    mass2 = np.bincount(word_of, taken2, minlength=len(per_word))
    gamma3 = np.bincount(pair_of, taken3, minlength=len(n2)) / np.maximum(total3, 1)
    parts = {"alpha2": quantised((n2 - taken2) / word_n[word_of]), "alpha3": quantised((n3 - taken3) / total3[pair_of]), "gamma3": quantised(gamma3), "gamma2": quantised(mass2 / word_n)}
    return parts, {low: float(mass2[0]), low + len(per_word) - 1: float(mass2[-1])}


class Model:
    """A trained model: vocabulary, tries by range of pairs, gammas of words whose pairs are in several tries."""

    def __init__(self, vocabulary: Vocabulary, tries: list[tuple[str, str]], shared: dict[int, float]):
        self.vocabulary, self.tries, self.shared = vocabulary, tries, shared  # by trie: the files of its levels and probabilities
        self.shards = len(tries)
        self.open: dict[int, dict | None] = {}
        self.shared_ids = np.array(sorted(shared), np.int64)
        self.shared_gamma = np.array([shared[k] for k in sorted(shared)])

    def __reduce__(self):
        return Model, (self.vocabulary, self.tries, self.shared)

    def trie(self, s: int) -> dict | None:
        if s not in self.open:
            self.open[s] = open_mapped(self.tries[s][0]) | open_mapped(self.tries[s][1]) if self.tries[s][0] else None
        return self.open[s]

    def by_trie(self, number: np.ndarray) -> Iterator[tuple[dict, slice]]:
        """The tries of an ascending list of their numbers and the places of each."""
        for s in np.unique(number).tolist():
            if (t := self.trie(s)) is not None:
                yield t, slice(*np.searchsorted(number, [s, s + 1]))

    def unigram(self, n: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        return (n + 0.5) / (v.total + 0.5 * (v.size + 1))

    def gammas(self, ids: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What each context of one word leaves to the level below, of ascending known ids."""
        value = np.ones(len(ids))
        k = np.minimum(np.searchsorted(self.shared_ids, ids), max(len(self.shared_ids) - 1, 0))
        is_shared = self.shared_ids[k] == ids if len(self.shared_ids) else np.zeros(len(ids), bool)
        value[is_shared] = self.shared_gamma[k[is_shared]]
        # a word that is no trie's first or last has all its pairs in one trie, that of the middle of its range
        rest = np.flatnonzero(~is_shared)
        total = self.vocabulary.total
        for t, part in self.by_trie(_pair_shard(n[rest], before[rest], 0, total / 2, total, self.shards)):
            at = rest[part]
            at = at[(ids[at] >= t["low"]) & (ids[at] <= t["high"])]
            value[at] = _value(t["gamma2"][ids[at] - t["low"]])
        return value

    def probabilities(self, place: np.ndarray, ids: np.ndarray, n: np.ndarray, before: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
        """Probability of each token after the two before it.

        Tokens are places in a list of distinct words (id or -1, count, tokens of smaller ids) in ascending order; ``first``
        marks the tokens that begin a text, whose context is the word ``end``.
        """
        v, many = self.vocabulary, len(ids)
        p1 = self.unigram(n)
        if not v.total or not len(place):
            return p1[place]
        context = np.where(first, end, np.concatenate([[end], place[:-1]]))
        pair, back = np.unique(context * many + place, return_inverse=True)
        c, w = np.divmod(pair, many)
        asked = np.flatnonzero((ids[c] >= 0) & (ids[w] >= 0))
        trie_of = np.full(len(pair), -1)
        trie_of[asked] = _pair_shard(n[c[asked]], before[c[asked]], n[w[asked]], before[w[asked]], v.total, self.shards)
        found, p2 = np.full(len(pair), -1, np.int64), np.zeros(len(pair))
        for t, part in self.by_trie(trie_of[asked]):
            at = asked[part]
            at = at[(ids[c[at]] >= t["low"]) & (ids[c[at]] <= t["high"])]
            got = _child(t["words2"], t["pointers2"], ids[c[at]] - t["low"], ids[w[at]])[0]
            found[at] = got
            p2[at[got >= 0]] = _value(t["alpha2"][got[got >= 0]])
        known = np.flatnonzero(ids >= 0)
        gamma = np.ones(many)
        gamma[known] = self.gammas(ids[known], n[known], before[known])
        p2 += gamma[c] * p1[w]
        p = p2[back]
        # the pair before each token that is not its text's first; distinct triples in the order of tries and places
        later = np.flatnonzero(~first)
        later = later[found[back[later - 1]] >= 0]
        if not len(later):
            return np.minimum(p, 1.0)
        triple, again = np.unique(back[later - 1] * many + place[later], return_inverse=True)
        token = np.empty(len(triple), np.int64)
        token[again] = later  # any of a triple's tokens
        before_pair, word, p3 = back[token - 1], ids[place[token]], p[token]
        for t, part in self.by_trie(trie_of[before_pair]):
            at = found[before_pair[part]]
            # a word unknown to the vocabulary has no pair before it, but may come after one
            known = np.flatnonzero(word[part] >= 0)
            got, some = np.full(len(at), -1, np.int64), np.ones(len(at), bool)
            got[known], some[known] = _child(t["words3"], t["pointers3"], at[known], word[part][known])
            own = p3[part].copy()
            own[some] *= _value(t["gamma3"][at[some]])
            own[got >= 0] += _value(t["alpha3"][got[got >= 0]])
            p3[part] = own
        p[later] = p3[again]
        return np.minimum(p, 1.0)


def train(docs: DataFrame) -> Model:
    """The model of all texts of ``docs`` (text)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    vocabulary = train_vocabulary(docs, parts)
    if not vocabulary.total:
        return Model(vocabulary, [("", "")], {})
    shards = -(-vocabulary.total // TRIE_TOKENS)
    folder = fresh_dir(spark, "lm-tries")
    bits = (vocabulary.size + 1).bit_length()
    end_of = lambda: tuple(x[0] for x in vocabulary.lookup(np.array([END])))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def sent():
            s, *cols = (np.concatenate([x[k] for x in held]) for k in range(4))
            order, first = _order(cols)  # tries are ranges of pairs, so the order of triples is that of tries
            n = np.diff(np.append(first, len(order))).astype(np.uint32)
            at = order[first]
            cut = np.searchsorted(s[at], np.arange(shards + 1))
            kind = np.uint32 if bits <= 32 else np.uint64
            for k in range(shards):
                if cut[k] < cut[k + 1]:
                    part = at[cut[k] : cut[k + 1]]
                    w = [c[part] for c in cols]
                    yield _send(k, [w[0][:1].astype(np.uint64), np.diff(w[0], prepend=w[0][:1]).astype(kind), w[1].astype(kind), w[2].astype(kind), n[cut[k] : cut[k + 1]]])

        size = 0
        for part in text_slices(batches, most=SLICE):
            place, ids, n, before, at = _numbered(part.column(0), vocabulary)
            end_id, end_n, end_before = end_of()
            first = np.zeros(len(place), bool)
            first[at[:-1]] = True
            last = np.zeros(len(place), bool)
            last[at[1:] - 1] = True
            w2 = ids[place]
            shift = lambda x, end: np.where(first, end, np.concatenate([[end], x[:-1]]))
            w1 = shift(w2, end_id)
            w3 = np.where(last, vocabulary.size, np.concatenate([w2[1:], [vocabulary.size]]))
            shard = _pair_shard(shift(n[place], end_n), shift(before[place], end_before), n[place], before[place], vocabulary.total, shards)
            kind = np.uint32 if bits <= 32 else np.uint64
            held.append([shard.astype(np.int32), w1.astype(kind), w2.astype(kind), w3.astype(kind)])
            size += len(w1)
            if size > FLUSH:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, runs in _receive(batches):
            cols = [np.concatenate([r[0][0] + np.cumsum(r[1], dtype=np.uint64) for r in runs]), np.concatenate([r[2] for r in runs]).astype(np.uint64), np.concatenate([r[3] for r in runs]).astype(np.uint64)]
            order, first = _order(cols)
            n = np.add.reduceat(np.concatenate([r[4] for r in runs])[order].astype(np.int64), first)
            levels, counts = build_levels(*(c[order[first]] for c in cols), n, vocabulary)
            path = f"{folder}/{s}-{np.random.default_rng().integers(1 << 62):x}.levels"
            dump(path, levels)
            b = _send(s, [c.astype(np.uint32) for c in counts])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([path]), pa.array([levels["low"]], pa.int64()), pa.array([counts_of_counts(counts[2])], pa.list_(pa.int64())), pa.array([counts_of_counts(counts[3])], pa.list_(pa.int64()))], names=[*b.schema.names, "path", "low", "of2", "of3"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                counts = [x.astype(np.int64) for x in next(_receive(iter([b.slice(i, 1)])))[1][0]]
                probabilities, ends = build_probabilities(b.column(5)[i].as_py(), counts, vocabulary, d2, d3)
                path = f"{folder}/{b.column(0)[i]}-{np.random.default_rng().integers(1 << 62):x}.probabilities"
                dump(path, probabilities)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(4).slice(i, 1), pa.array([path]), pa.array([list(ends)], pa.list_(pa.int64())), pa.array([list(ends.values())], pa.list_(pa.float64()))], names=["shard", "levels", "probabilities", "ends", "mass"])

    with scratch(spark) as stay:
        stay.append(folder)
        sent = docs.select("text").mapInArrow(events, RUN).repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard")
        levels = materialise(sent.mapInArrow(write, RUN + ", path string, low long, of2 array<long>, of3 array<long>"), "lm-levels")
        sums = levels.select(*[F.sum(F.get(c, F.lit(k))) for c in ("of2", "of3") for k in range(4)]).first()
        d2, d3 = discounts(list(sums[:4])), discounts(list(sums[4:]))
        made = {r["shard"]: r for r in materialise(levels.repartition(parts, "shard").mapInArrow(finish, "shard int, levels string, probabilities string, ends array<long>, mass array<double>"), "lm-made").collect()}
    mass: dict[int, float] = {}
    for s in sorted(made):
        for word, m in zip(made[s]["ends"], made[s]["mass"], strict=True):
            mass[word] = mass.get(word, 0.0) + m
    split = sorted(mass)  # every word that begins or ends a trie
    n = vocabulary.of_ids(np.array(split, np.int64))
    return Model(vocabulary, [(made[s]["levels"], made[s]["probabilities"]) if s in made else ("", "") for s in range(shards)], {w: mass[w] / int(k) for w, k in zip(split, n, strict=True)})


SCORES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, ...SCORES) of (doc_id, held_out, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=SCORED):
            place, ids, n, before, at = _numbered(part.column(2), model.vocabulary)
            first = np.zeros(len(place), bool)
            first[at[:-1]] = True
            p = model.probabilities(place, ids, n, before, first, int(place[at[1] - 1]))
            sums = lambda x: np.add.reduceat(x, at[:-1])
            columns = [np.diff(at), sums((n > 0)[place].astype(np.int64)), np.full(part.num_rows, model.vocabulary.total), sums(np.log10(model.unigram(n))[place]), sums(np.log10(p))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in columns)], names=["doc_id", "held_out", *SCORES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores of all ``docs`` under the model of those outside the held-out fold (crc32 of the id modulo 5 is 1)."""
    rows = docs.select("doc_id", (held_out(F.col("doc_id")) == 1).alias("held_out"), "text")
    return score_texts(rows, train(rows.where(~F.col("held_out")).select("text")))
