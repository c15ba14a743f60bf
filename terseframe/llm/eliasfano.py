"""Elias-Fano sequences over memory-mapped words, with vectorised access and successor search."""

from __future__ import annotations

import json
import tempfile

import numpy as np

from .common import read_bytes, split_uri, write_bytes

_U = np.uint64
#: A skip entry covers 2**SKIP values of the high part, a hint every 2**HINT elements.
SKIP, HINT = 2, 6


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other in 64-bit words, and a word of padding."""
    if width == 0 or not len(values):
        return np.zeros(1, np.uint64)
    out, step = [], 1 << 16
    for lo in range(0, len(values), step):
        bits = ((values[lo : lo + step, None] >> np.arange(width, dtype=np.uint64)) & _U(1)).astype(np.uint8)
        out.append(np.packbits(bits.ravel(), bitorder="little"))
    data = np.concatenate(out)
    padded = np.zeros((len(data) + 7) // 8 * 8 + 8, np.uint8)
    padded[: len(data)] = data
    return padded.view(np.uint64)


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * _U(width)
    w, s = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    low = words[w] >> s
    high = np.where(s > 0, words[w + 1] << (_U(64) - np.maximum(s, _U(1))), _U(0))
    return (low | high) & _U((1 << width) - 1)


#: Place of the r-th set bit of a byte, at byte * 8 + r.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.uint64)
_ONES, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)


def select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each 64-bit word."""
    r = r.astype(np.uint64)
    n = x - ((x >> _U(1)) & _U(0x5555555555555555))
    n = (n & _U(0x3333333333333333)) + ((n >> _U(2)) & _U(0x3333333333333333))
    upto = ((n + (n >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte k: set bits of bytes 0 to k
    enough = ((upto | _HIGH) - (r + _U(1)) * _ONES) & _HIGH
    shift = (_U(8) - np.bitwise_count(enough)) * _U(8)
    r = r - (((upto << _U(8)) >> shift) & _U(0xFF))
    return shift + _IN_BYTE[(((x >> shift) & _U(0xFF)) * _U(8) + r).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers in about 2 + log2(universe / n) bits each, and directories."""

    FIELDS = ("low", "high", "rank", "hint", "skip")

    def __init__(self, n: int, width: int, arrays: dict[str, np.ndarray]):
        self.n, self.width = n, width
        self.low, self.high, self.rank, self.hint, self.skip = (arrays[f] for f in self.FIELDS)
        self.most = int(self.access(np.array([n - 1]))[0] >> _U(width)) if n else 0  # the largest high part

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        highs = (values >> _U(width)).astype(np.int64)
        most = int(highs[-1]) if n else 0
        bits = np.zeros((n + most + 64) // 64 * 64, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        hint = np.append((highs + np.arange(n))[:: 1 << HINT] >> 6, len(high) - 1).astype(np.uint32)
        skip = np.searchsorted(highs, np.arange(0, most + (2 << SKIP), 1 << SKIP)).astype(np.uint32)
        return cls(n, width, {"low": pack(values, width), "high": high, "rank": rank, "hint": hint, "skip": skip})

    def _select(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word of the high part, and place in it, of each element's bit."""
        w, last = self.hint[i >> HINT].astype(np.int64), self.hint[(i >> HINT) + 1].astype(np.int64)
        todo = np.flatnonzero(w < last)
        while len(todo):
            mid = (w[todo] + last[todo]) >> 1
            after = self.rank[mid + 1] <= i[todo]
            w[todo] = np.where(after, mid + 1, w[todo])
            last[todo] = np.where(after, last[todo], mid)
            todo = todo[w[todo] < last[todo]]
        return w, select_in_word(self.high[w], i - self.rank[w])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``, each in [0, n)."""
        if not len(i):
            return np.zeros(0, np.uint64)
        w, bit = self._select(i)
        return ((w * 64 - i).astype(np.uint64) + bit << _U(self.width)) | unpack(self.low, self.width, i)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and ``i + 1``, both in [0, n); the second bit is mostly in the first one's word."""
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        w, bit = self._select(i)
        rest = (self.high[w] >> bit) & ~_U(1)
        start = (w * 64 - i).astype(np.uint64) + bit
        step = np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.uint64)
        first = (start << _U(self.width)) | unpack(self.low, self.width, i)
        second = (start + step - _U(1) << _U(self.width)) | unpack(self.low, self.width, i + 1)
        far = np.flatnonzero(rest == 0)
        second[far] = self.access(i[far] + 1)
        return first, second

    def _upto(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is at most ``h``, by a search for its zero between the words of directory entries k and k + 1."""
        lo = (self.skip[k].astype(np.int64) + (k << SKIP)) >> 6
        hi = np.minimum((self.skip[k + 1].astype(np.int64) + (k + 1 << SKIP)) >> 6, len(self.high) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo] + 1) >> 1
            before = mid * 64 - self.rank[mid] <= h[todo]
            lo[todo] = np.where(before, mid, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid - 1)
            todo = todo[lo[todo] < hi[todo]]
        return lo * 64 + select_in_word(~self.high[lo], h - (lo * 64 - self.rank[lo])).astype(np.int64) - h

    def _high_range(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places [a, b) of the elements whose high part is ``h``, mostly from one window of 64 bits of the unary code."""
        last = len(self.skip) - 2
        k = np.minimum(h >> SKIP, last)
        e = self.skip[k].astype(np.int64)
        at = e + (k << SKIP)
        w = np.minimum(at >> 6, len(self.high) - 1)
        s = (at & 63).astype(np.uint64)
        after = self.high[np.minimum(w + 1, len(self.high) - 1)]
        zeros = ~((self.high[w] >> s) | np.where(s > 0, after << ((_U(64) - s) & _U(63)), _U(0)))
        r = h - (k << SKIP)
        a = np.zeros(len(h), np.int64)
        for j in range((1 << SKIP) - 1):
            more = np.flatnonzero(r > j)
            z = zeros[more]
            low = z & (~z + _U(1))
            a[more] = np.bitwise_count(low - _U(1)).astype(np.int64) + 1
            zeros[more] = z ^ low
        b = np.bitwise_count((zeros & (~zeros + _U(1))) - _U(1)).astype(np.int64)
        beyond = (r >= 1 << SKIP) | (h > self.most)
        a, b = np.where(beyond, self.n, e + a - r), np.where(beyond, self.n, e + b - r)
        far = np.flatnonzero(~beyond & ((zeros == 0) | (w + 1 >= len(self.high))))  # codes longer than the window, or at its end
        if len(far):
            b[far] = self._upto(h[far], k[far])
            a[far] = np.where(h[far] > 0, self._upto(np.maximum(h[far] - 1, 0), np.maximum(h[far] - 1, 0) >> SKIP), 0)
        return a, b

    def _search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in [lo, hi) whose value is at least x, or hi; and whether it is x."""
        a, b = self._high_range((x >> _U(self.width)).astype(np.int64))
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        end, low = b.copy(), x & _U((1 << self.width) - 1)
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = unpack(self.low, self.width, mid) < low[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)
            todo = todo[a[todo] < b[todo]]
        found = np.zeros(len(x), bool)
        some = np.flatnonzero(a < end)
        found[some] = unpack(self.low, self.width, a[some]) == low[some]
        return a, found

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose value is at least x, or hi."""
        return self._search(x, lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of x in [lo, hi), or -1."""
        if self.n == 0 or not len(x):
            return np.full(len(x), -1, np.int64)
        lo = np.zeros(len(x), np.int64) if lo is None else lo
        hi = np.full(len(x), self.n, np.int64) if hi is None else hi
        at, found = self._search(x, lo, hi)
        return np.where(found, at, -1)


def dump(path: str, parts: dict) -> None:
    """Write arrays and sequences to one file: a JSON header, then 8-byte aligned arrays."""
    head, blobs, at = {}, [], 0

    def put(a: np.ndarray) -> dict:
        nonlocal at
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        entry = {"at": at, "n": len(a), "type": a.dtype.str}
        blobs.append(raw)
        at += len(raw)
        return entry

    for name, x in parts.items():
        if isinstance(x, EliasFano):
            head[name] = {"n": x.n, "width": x.width} | {f: put(getattr(x, f)) for f in EliasFano.FIELDS}
        elif isinstance(x, np.ndarray):
            head[name] = put(x)
        else:
            head[name] = {"value": x}
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    write_bytes(path, len(text).to_bytes(8, "little") + text + b"".join(blobs))


def open_mapped(path: str) -> dict:
    """The parts of a file of :func:`dump` over a memory map; files of remote stores are first copied to a file of the task that ends with it."""
    store, local = split_uri(path)
    if store.type_name != "local":
        with tempfile.NamedTemporaryFile() as f:  # the map outlives the name
            f.write(read_bytes(path))
            f.flush()
            data = np.memmap(f.name, np.uint8, "r")
    else:
        data = np.memmap(local, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())

    def get(e: dict) -> np.ndarray:
        kind = np.dtype(e["type"])
        start = 8 + size + e["at"]
        return data[start : start + e["n"] * kind.itemsize].view(kind).view(np.ndarray)

    out = {}
    for name, e in head.items():
        if "width" in e:
            out[name] = EliasFano(e["n"], e["width"], {f: get(e[f]) for f in EliasFano.FIELDS})
        else:
            out[name] = e["value"] if "value" in e else get(e)
    return out
